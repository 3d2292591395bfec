"""Stages of the pipeline, each on what its predecessor kept."""

import pyarrow as pa

import corpus_pipeline
from tarnwell.llm import langid, neardup, quality, secrets

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before, docs)
        assert name == "packing" or docs.columns == names
    before, after = kept["language"]
    model = langid.learned(before)
    rows = before.collect()
    home = model.at_home(pa.array([r["text"] for r in rows]))
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r, h in zip(rows, home, strict=True) if h}
    before, after = kept["quality"]
    rules = quality.learned(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in quality.judged(before, rules).where("kept").collect()}
    before, after = kept["near_duplicates"]
    assert {r["doc_id"] for r in after.collect()} == {r["class_id"] for r in neardup.near_duplicates(before).collect()}
    before, after = kept["secrets"]
    assert after.count() == before.count() and secrets.secrets(after).where("n_hex > 0").count() == 0
    assert {r["doc_id"] for r in kept["packing"][1].collect()} == {r["doc_id"] for r in after.collect()}
    assert corpus_pipeline.run(spark, SF).count() == kept["packing"][1].count()


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, an empty table, and columns with clashing names, with the rows that each stage leaves."""
    said = "many different words of a text that goes on for quite some time and says what it says about this and that " * 3
    rows = [(1, None, None), (2, "", "en"), (None, said + "end", "en"), (4, said, "fr"), (4, said, "fr"), (5, " \n ", "de"), (4, "password=abcdefgh12 here", "en"), (6, said, None), (None, None, "en")]
    extra = ["key", "node", "part", "base", "spans", "row", "id", "n", "first", "own", "__t"]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{x}` string" for x in extra)
    docs = spark.createDataFrame([(i, t, x, "s", 3, *extra) for i, t, x in rows], kind)
    spark.createDataFrame([(4, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    left = {
        "language": [r for r in rows if r[1] and r[1].strip()],
        "quality": [],  # words of all texts are repeated, or too few
        "near_duplicates": [rows[i] for i in (0, 1, 3, 5, 6, 8)],
        "secrets": [r if not r[1] or "password" not in r[1] else (r[0], "[SECRET] here", r[2]) for r in rows],
    }
    for name, want in left.items():
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = [(r["doc_id"], r["text"], r["lang"]) for r in out.collect()]
        assert sorted(got, key=str) == sorted(want, key=str), name
        assert all(r[x] == x for r in out.collect() for x in extra)
        assert stages[name](spark, docs.limit(0), str(tmp_path)).count() == 0
    assert stages["packing"](spark, docs, str(tmp_path)).count() == len(rows) and stages["packing"](spark, docs.limit(0), str(tmp_path)).count() == 0
