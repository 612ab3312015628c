import zlib

import numpy as np
import public_tokenizers
from common import SF, awkward, empty, smallest
from docops.llm.queries import op8_token_files
from docops.llm.token_files import TokenFile, read_token_files, write_token_files
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(texts):
    t, at, out, stream = Tokenizer.from_file(PATH), 0, {}, []
    for i in sorted(texts):
        ids = [*t.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        out[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        stream += ids
    return out, stream


def got(df):
    return {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in df.collect()}


def test_awkward(spark, tmp_path):
    df, texts = awkward(spark)
    odd = ["İstanbul, ISTANBUL!! don't 'tis we're o'clock's", "été á. ́x ﬁ Σίσυφος ΑΣ ΑΣ.", "3.14, 2nd x_y <|endoftext|> a<|endoftext|>b (x)  y z　w", "…,,, —!! a…, b.", "😀👍 ok!", "ab\x1ccd \x85ef", "THE!! The, the."]
    texts |= {1000 + i: t for i, t in enumerate(odd)}
    df = df.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"), allowMissingColumns=True)
    manifest = write_token_files(df, f"file://{tmp_path}/t", PATH, length=64).cache()
    want, stream = brute(texts)
    assert got(read_token_files(manifest)) == want
    ids = []
    for f in sorted(manifest.collect()):
        file = TokenFile(f.path)
        for i in range(sum(file.file.get_batch(b).num_rows for b in range(file.file.num_record_batches))):
            x, mask = file.sequence(i)
            assert len(x) == len(mask) == 64
            ids += x[mask].tolist()
    assert ids == stream


def test_empty(spark, tmp_path):
    assert read_token_files(write_token_files(empty(spark), f"file://{tmp_path}/e", PATH)).collect() == []


def test_query(spark):
    assert got(op8_token_files(spark, SF)) == brute(smallest())[0]
