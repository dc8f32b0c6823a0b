"""The stages against what each must do to its own input."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from counterloom.llm import quality_model
from counterloom.llm import queries as Q
from counterloom.llm.store import written

from .conftest import ODD, table, words
from .test_dedup import near
from .test_quality import judged_rows


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    docs, labels = judged_rows(150)
    item = words(40, 7700)
    docs += [(300, f"{words(30, 7800)} {item}"), (301, docs[0][1]), (302, docs[0][1] + " end"), (303, f"{words(40, 7900)} write to jane.roe@mail.example.com please {words(40, 7901)}")]
    root = str(tmp_path_factory.mktemp("data"))
    table(spark, docs + ODD).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_do_their_part(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES[:-1]:
        after = written(stage(spark, docs, data), name)
        assert after.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in after.collect()}
        before, docs = docs, after
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    first = kept["quality-classifier"]
    scores = quality_model.quality_scores(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet").where(~Q.held_out()))
    assert set(first) == {r["doc_id"] for r in scores.where("score >= 0.3").collect()}
    assert sum(i in first for i, q in labels.items() if q == 1) > 0.95 * sum(q == 1 for q in labels.values())
    assert sum(i in first for i, q in labels.items() if q == 0) < 0.2 * sum(q == 0 for q in labels.values())
    classes = near(list(first.items()))
    assert set(kept["near-duplicates"]) - {None} == {i for i, (c, _) in classes.items() if c == i}
    assert kept["near-duplicates"].keys() - kept["decontamination"].keys() == {300}
    assert "jane.roe" not in kept["personal-data"][303] and kept["personal-data"].keys() == kept["decontamination"].keys()
    packed = P.STAGES[-1][1](spark, docs, data)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept["personal-data"])
    assert P.run(spark, data).count() == packed.count()


def test_stages_decide_by_row(spark, data):
    columns = spark.read.parquet(f"{data}/documents.parquet").columns
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    bad = [texts[i] for i, q in labels.items() if q == 0][:5]
    clean = [words(60, 9100 + i) for i in range(5)]
    same = [(8000 + i, t) for i, t in enumerate(clean)] + [(8000 + i, t) for i, t in enumerate(bad)] + [(None, t) for t in bad] + [(None, words(60, 9200))]
    docs = table(spark, [(i, t) for i, t in texts.items() if i is not None] + same).select(columns)
    left = [(r["doc_id"], r["text"]) for r in P.keep_quality(spark, docs, data).collect()]
    assert not [x for x in left if x[1] in bad] or sum(x[1] in bad for x in left) < 0.2 * 3 * len(bad)
    assert all((8000 + i, t) in left for i, t in enumerate(clean)) and (None, words(60, 9200)) in left

    one, two, three = (words(60, 9300 + i) for i in range(3))
    rows = [(5, one), (5, two), (None, one), (None, three), (None, three), (7, two), (4, two + " end"), (5, one)]
    left = [(r["doc_id"], r["text"]) for r in P.keep_first_copies(spark, table(spark, rows), data).collect()]
    assert sorted(left, key=str) == sorted([(5, one), (4, two + " end"), (None, three)], key=str)

    item = spark.read.parquet(f"{data}/benchmark.parquet").first()["text"]
    rows = [(5, one), (5, f"{one} {item}"), (None, f"{two} {item}"), (None, two), (6, None)]
    left = [(r["doc_id"], r["text"]) for r in P.keep_uncontaminated(spark, table(spark, rows), data).collect()]
    assert sorted(left, key=str) == sorted([(5, one), (None, two), (6, None)], key=str)


def test_entry_has_all_queries():
    names = entry.queries()
    assert {n.split("_")[0] for n in Q.QUERIES} == {f"op{i}" for i in range(1, 14)} and set(Q.QUERIES) < set(names) and "pipeline" in names
    assert set(Q.ORACLE) < set(entry.oracle_sql())
