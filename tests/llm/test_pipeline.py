"""Every stage of the pipeline, and the whole of it, against brute force on whole small tables."""

from collections import Counter
from fractions import Fraction

import pytest

import corpus_pipeline as pipeline
from gridloom.llm import decontaminate, toxicity
from tests.llm.test_operators import SF, check_packing, components_brute

ODD = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (9001, None, "en", "a", None),
    (9002, "", None, None, 0),
    (9003, "", None, None, 0),
    (9004, "one two three four five six seven eight", "en", "a", 40),
    (9004, "one two three four five six seven eight", "en", "a", 40),
    (9005, "One two  three four five six seven eight", "en", "b", 41),
    (None, "nobody knows the number of this row", "en", "b", 35),
    (None, "nobody knows the number of this row", "en", "b", 35),
    (9006, "line\nown words here\n", "en", "s", 20),
    (9007, "line\nother words there", "en", "s", 21),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('stage')}/docs"
    base = spark.read.parquet(f"{SF}/documents.parquet")
    base.unionByName(spark.createDataFrame(ROWS, ODD)).write.parquet(path)
    return spark.read.parquet(path)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_toxicity_stage(spark, docs):
    out = pipeline.toxicity(spark, docs, SF)
    assert out.columns == docs.columns
    models = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    fate = {r.doc_id: r.score < 0.5 for r in toxicity.score_toxicity(docs, models).collect()}
    assert rows(out) == Counter({r: n for r, n in rows(docs).items() if fate[r[0]]})
    assert pipeline.toxicity(spark, docs.limit(0), SF).count() == 0


def test_line_stage(spark, docs):
    out = pipeline.line_deduplication(spark, docs, SF)
    assert out.columns == docs.columns
    trim = lambda x: x.replace("\t", " ").replace("\r", " ").strip(" ")
    every = [tuple(r) for r in docs.collect()]
    pages, on = Counter(r[3] for r in every), Counter()
    for r in every:
        on.update((r[3], line) for line in {trim(x) for x in (r[1] or "").split("\n")} - {""})
    want = Counter()
    for d, text, lang, source, _ in every:
        if text is not None:
            text = "\n".join(x for x in text.split("\n") if not (on[source, trim(x)] >= 2 and on[source, trim(x)] > 0.02 * pages[source]))
        want[d, text, lang, source, None if text is None else len(text)] += 1
    assert rows(out) == want
    assert {r.text for r in out.where("source = 's'").collect()} == {"own words here\n", "other words there"}


def test_near_duplicate_stage(spark, docs):
    out = pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    every = [(i, *r) for i, r in enumerate(sorted((tuple(r) for r in docs.collect()), key=str))]
    named = components_brute([(i, r[1]) for i, *r in every], 5, Fraction(4, 5))
    groups = {}
    for i, size, name in named:
        groups.setdefault(name if size else ("alone", i), []).append(every[i][1:])
    want = Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0, str(r))) if len(g) > 1 else g[0] for g in groups.values())
    assert Counter((r[0], r[1]) for r in rows(out).elements()) == Counter((r[0], r[1]) for r in want.elements())
    assert out.where("doc_id = 9004").count() == 1 and out.where("doc_id is null").count() == 1 and out.where("doc_id in (9001, 9002, 9003)").count() == 3


def test_decontamination_stage(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.first().text
    more = docs.unionByName(spark.createDataFrame([(9100, f"before {item} after", "en", "a", 1)], ODD))
    out = pipeline.decontamination(spark, more, SF)
    leaks = {r.doc_id for r in decontaminate.find_leaks(more, bench).collect() if r.leaks}
    assert 9100 in leaks and {r[0] for r in rows(docs) if any(b.text in (r[1] or "") for b in bench.collect())} <= leaks
    assert rows(out) == Counter({r: n for r, n in rows(more).items() if r[0] not in leaks})


def test_packing_stage(spark, docs):
    single = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(pipeline.packing(spark, single, SF).collect(), {r.doc_id: r.text for r in single.collect()})
    assert pipeline.packing(spark, docs.limit(0), SF).count() == 0


def test_run_is_its_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert 0 < docs.count() < spark.read.parquet(f"{SF}/documents.parquet").count()
    check_packing(pipeline.run(spark, SF).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "packing"]
