"""Repeated rows, rows without doc_id, clashing column names, empty tables: every operator and every stage."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from common import awkward, empty
from docops.llm import license_scan, toxicity
from docops.llm.best_fit import packed
from docops.llm.block_dedup import dedup_blocks
from docops.llm.decontaminate import contaminated
from docops.llm.host_rules import host_rules
from docops.llm.ngram_join import linked
from docops.llm.quality_lm import quality
from docops.llm.suffix_dedup import dedup_suffixes
from docops.llm.token_files import token_files
from pyspark.sql import functions as F

CLASHES = ["host", "chunk", "part", "tile", "band", "component", "piece", "bin_id", "w", "limit", "bucket", "payload", "blob", "k", "h", "bits", "held", "term", "toxic", "n", "u", "v", "id", "label", "size", "cluster", "shard", "kept", "key", "word", "t", "l", "a", "at", "held_out", "family", "item_id", "shift"]
REPEATED = "doc_id % 5 = 1"


@pytest.fixture(scope="module")
def tables(spark):
    """The awkward documents; the same with repeated rows, rows without doc_id and clashing columns; labels; items."""
    plain, texts = awkward(spark)
    plain = plain.drop("n_chars").cache()
    more = plain.unionByName(plain.where(REPEATED)).unionByName(plain.limit(7).withColumn("doc_id", F.lit(None).cast("long")))
    more = more.withColumns({c: F.lit(f"<{c}>") for c in CLASHES}).repartition(5).cache()
    trusted = [i for i, t in sorted(texts.items()) if i % 5 != 1 and t]
    labels = spark.createDataFrame([(i, 1, int(n % 3 == 0), "x") for n, i in enumerate(trusted)], "doc_id long, quality int, toxic int, text string")
    items = spark.createDataFrame([(1, texts[1], "x"), (None, texts[1], "x"), (2, None, "x"), (3, "one  two\nthree four five", "x")], "item_id long, text string, doc_id string")
    return plain, more, labels, items


def both(tables, fn, columns):
    """Rows of the plain table as often as the other table repeats them, and what the operator gave for that one."""
    plain, more, *_ = tables
    times = Counter(r.doc_id for r in more.select("doc_id").collect())
    rows = lambda df: Counter(tuple(str(r[c]) for c in ("doc_id", *columns)) for r in df.collect())
    want = Counter({r: n * times[int(r[0])] for r, n in rows(fn(plain)).items()})
    return want, rows(fn(more))


def test_rows_are_judged_alike(spark, tables):
    plain, more, labels, items = tables
    index = toxicity.fit(plain, labels)
    model = license_scan.fit(plain)
    for fn, columns in [
        (lambda df: linked(df, 4, 85), ("n_shingles", "component_id")),
        (dedup_blocks, ("n_words", "n_removed", "kept_sha256")),
        (lambda df: toxicity.score_toxicity(df, index), ("held_out", "score", "predicted")),
        (lambda df: quality(df, labels), ("n_bytes", "perplexity", "threshold", "kept")),
        (lambda df: token_files(df, public_tokenizers.path("word_bpe_49k.json")), ("n_tokens", "ids_crc32")),
        (host_rules, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")),
        (lambda df: license_scan.scan(df, model), ("family", "probability", "paragraph", "n_paragraphs")),
        (packed, ("piece", "start", "n_words")),
    ]:
        want, got = both(tables, fn, columns)
        assert got == want


def test_repeated_rows_of_the_others(spark, tables):
    plain, more, labels, items = tables
    assert sorted(contaminated(more, items).collect()) == sorted(contaminated(plain, items).collect()) != []
    first = {r.doc_id: r for r in dedup_suffixes(plain).collect()}
    got = dedup_suffixes(more).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in more.where("doc_id IS NOT NULL").select("doc_id").collect())
    for i, r in first.items():
        own = [x for x in got if x.doc_id == i]
        assert r in own and all(x == r or x.n_removed == (x.n_bytes if x.n_bytes >= 100 else 0) for x in own)


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, tables, tmp_path, stage):
    plain, more, labels, items = tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    fn = corpus_pipeline.STAGES[stage][1]
    out = fn(spark, more, str(tmp_path))
    got, base = Counter(r.doc_id for r in out.collect()), Counter(r.doc_id for r in fn(spark, plain, str(tmp_path)).collect())
    assert None not in got and set(base) <= set(got) <= {r.doc_id for r in more.collect()} and (stage == 2 or set(got) == set(base))
    none = fn(spark, more.limit(0), str(tmp_path))
    assert none.collect() == [] and none.columns == out.columns
    if stage < 4:
        assert out.columns == more.columns
        kept = {r.doc_id: r.text for r in out.collect()}
        before = {r.doc_id: r.text for r in plain.collect()}
        assert stage == 2 or all(kept[i] == before[i] for i in kept)
        nulls = {i for i, t in before.items() if t is None}
        assert (nulls <= set(got)) == (stage in (1, 3))


def test_empty_tables(spark):
    none = empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (linked(none), dedup_suffixes(none), packed(none), dedup_blocks(none), quality(none, labels), contaminated(none, items), host_rules(none), toxicity.score_toxicity(none, toxicity.calibrate(spark, toxicity.fit(none, labels)))):
        assert df.collect() == []


def test_parts_of_several_chunks(spark, monkeypatch, tables):
    """Chunks that travel in parts of three give what single ones give."""
    from docops.llm import block_dedup, chunks, ngram_join, quality_lm, suffix_dedup

    plain, _, labels, _ = tables
    fns = [dedup_suffixes, dedup_blocks, lambda df: linked(df, 4, 85), lambda df: quality(df, labels)]
    want = [sorted(map(str, fn(plain).collect())) for fn in fns]
    small = lambda docs, extra=(), size=0: chunks.chunked(docs, extra, 2000, 3)
    for module in (suffix_dedup, block_dedup, ngram_join, quality_lm):
        monkeypatch.setattr(module, "chunked", small)
    cut = [sorted(map(str, fn(plain.coalesce(2)).collect())) for fn in fns]
    assert cut[:3] == want[:3]
    plainly = lambda rows: [x.split("perplexity")[0] + x.split("kept")[1] for x in rows]
    assert plainly(cut[3]) == plainly(want[3])


def test_order_of_rows_does_not_matter(spark, tables):
    """A partition that is computed again with its rows in another order gives the same chunks."""
    from docops.llm.chunks import chunked

    plain = tables[0]
    one = plain.coalesce(1)
    other = plain.orderBy(F.desc(F.xxhash64("doc_id"))).coalesce(1)
    assert sorted(map(tuple, chunked(one).collect())) == sorted(map(tuple, chunked(other).collect()))
