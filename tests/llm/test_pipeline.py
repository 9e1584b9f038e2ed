"""The pipeline on a small corpus, stage by stage against brute force."""

import corpus_pipeline
import pytest
from test_llm import SPLIT, brute_join, brute_substring, prose

from tideline.llm import packing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    item = prose(77, 30)
    rows = [(i, prose(i, 50)) for i in range(40)]
    rows += [(100 + i, prose(i, 50)) for i in range(5)]  # exact copies
    rows += [(200 + i, prose(i, 49) + " other") for i in range(5)]  # near copies
    rows += [(300 + i, prose(500, 20) + " " + prose(600 + i, 40)) for i in range(5)]  # a shared passage
    rows += [(400, item), (401, prose(9000, 20) + " " + item), (402, item + " " + prose(9001, 2000)), (500, None), (501, ""), (502, "12 34 !!")]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, prose(78, 25))], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), item


def test_stages(spark, corpus):
    path, item = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, path).toArrow())
        steps[name] = docs
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    pairs = lambda name: sorted((r["doc_id"], r["text"]) for r in steps[name].collect())
    one = pairs("language_id")
    assert {i for i, _ in one}.isdisjoint({500, 501, 502}) and len(one) == 58
    two = pairs("ngram_join")
    assert [i for i, _ in two] == sorted(i for i, _, c in brute_join(one) if i == c)
    three = pairs("substring_dedup")
    want = {i: (n, gone) for i, n, gone, _ in brute_substring(two)}
    words = {i: len(SPLIT.findall(t.encode())) for i, t in three}
    assert words == {i: n - gone for i, (n, gone) in want.items() if n > gone}
    four = dict(pairs("decontaminate"))
    hit = [i for i, t in three if item in t and 20 * 30 >= words[i]]
    assert set(four) == {i for i, _ in three} - set(hit) and hit
    assert 402 in four and not any(item in t for t in four.values()) and SPLIT.findall(four[402].encode()) == SPLIT.findall(prose(9001, 2000).encode())
    tokens = steps["packing"].groupBy("doc_id").sum("length").collect()
    plain = packing.pieces(steps["decontaminate"]).groupBy("doc_id").sum("length").collect()
    assert sorted(map(tuple, tokens)) == sorted(map(tuple, plain)) and {r[0] for r in tokens} == set(four)


def test_run(spark, corpus):
    rows = corpus_pipeline.run(spark, corpus[0]).collect()
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, corpus[0]).toArrow())
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, rows)) == sorted(map(key, docs.collect())) and len(rows) > 30


def test_stages_of_odd_tables(spark, corpus):
    """Empty tables, repeated rows and columns with clashing names."""
    rows = [(1, prose(1, 60), "en", "s", 1)] * 3 + [(None, prose(2, 60), None, "s", None), (2, None, "en", None, 3), (3, "y" * 200_000 + " z", "en", "s", 4)]
    odd = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'a' lang_pred", "'b' key", "'c' mark", "'d' spans", "'e' hit_words", "'f' __key")
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, odd, corpus[0])
        assert got.columns == odd.columns and all((r["lang_pred"], r["key"], r["mark"], r["spans"], r["hit_words"], r["__key"]) == tuple("abcdef") for r in got.collect())
        assert stage(spark, odd.limit(0), corpus[0]).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, odd, corpus[0]).count() >= 6
