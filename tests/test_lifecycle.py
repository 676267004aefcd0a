import json

import pytest
from pyspark.sql import functions as F

from paperlake import catalog, corpus
from paperlake.operators import search as S
from paperlake.sources import readers


@pytest.fixture(scope="module")
def canonical(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    papers = [
        {"title": "Replay Memory", "authors": ["Ann", "ann", "Bo"], "abstract": "We study replay.", "doi": "https://doi.org/10.1/A", "url": "https://x/1", "track": "Conference", "presentation_level": "Oral", "source_provider": "openreview", "keywords": ["replay"]},
        {"title": "Replay memory!", "authors": [], "abstract": "", "url": "https://x/2", "institutions": ["Lab"], "record_status": "resolved"},
        {"title": "Other", "authors": ["Cy"], "abstract": "Text on memory.", "url": "https://x/3", "quality_flags": ["custom"]},
        {"title": "External", "url": "https://x/4"},
    ]
    (d / "iclr-2024.json").write_text(json.dumps({"query": {"venue_code": "ICLR", "year": 2024}, "papers": papers}))
    return corpus.normalise(readers.records(readers.payloads(spark, f"{d}/*.json"))).cache()


def test_normalise(canonical):
    got = {r["title"]: r for r in canonical.collect()}
    assert set(got) == {"Replay Memory", "Other", "External"}
    r = got["Replay Memory"]
    assert (r["authors"], r["doi"], r["track"], r["presentation_level"], r["institutions"], r["duplicates_removed"]) == (["Ann", "Bo"], "10.1/A", "main", "oral", ["Lab"], 1)
    assert r["paper_id"].startswith("S2-") and len(r["paper_id"]) == 19
    assert got["External"]["record_status"] == "placeholder" and "custom" in got["Other"]["quality_flags"]
    assert r["field_provenance"]["abstract"] == "official"
    assert canonical.columns[: len(corpus.CANONICAL)] == list(corpus.CANONICAL)


def test_gates(spark, canonical):
    official = spark.createDataFrame([("ICLR", 2024, 5)], "venue string, year int, n long")
    assert [(r.passed, r.warnings) for r in corpus.validate(canonical, official).collect()] == [(True, ["count"])]
    assert [(r.passed, r.issues) for r in corpus.validate(canonical, official, strict=True).collect()] == [(False, ["count"])]
    none = spark.createDataFrame([], "paper_id string")
    with pytest.raises(ValueError, match="blocked"):
        corpus.publish(canonical.limit(1), canonical, none, lambda df: "x")
    assert corpus.publish(canonical, canonical, none, lambda df: "x") == "x"


def test_catalog(spark, canonical, tmp_path):
    path = str(tmp_path / "cat")
    with pytest.raises(FileNotFoundError):
        catalog.load(spark, path, "papers")
    catalog.build(canonical, path)
    assert all(r.passed for r in catalog.validate(spark, path, canonical).collect())
    hits = catalog.search(spark, path, "memory", S.Filters(("ICLR",))).orderBy("rank").collect()
    want = S.bm25(canonical, "memory").collect()
    assert {r.paper_id: round(r.score, 9) for r in hits} == {r.paper_id: round(r.score, 9) for r in want}
    assert hits[0]["authors"] and {r.kind for r in catalog.stats(spark, path).collect()} == {"total", "status", "venue-year", "indexed"}
    one = catalog.get(spark, path, hits[0].paper_id).first()
    assert one.paper_id == hits[0].paper_id and isinstance(one.institutions, list)
    out = catalog.export(catalog.search(spark, path, "memory"), [("replay", ["replay"])])
    assert {r.label for r in out.collect()} == {"replay", "Other"}
    catalog.write_tsv(out, str(tmp_path / "tsv"), ["rank"])
    assert readers.tsv(spark, str(tmp_path / "tsv"), ("paper_id", "label")).count() == 2
    with pytest.raises(ValueError):
        readers.tsv(spark, str(tmp_path / "tsv"), ("nope",))
    catalog.reindex(spark, path)
    vec = canonical.select("paper_id").limit(1).union(spark.createDataFrame([("zz",)], "paper_id string"))
    report = {r["check"]: r.passed for r in catalog.doctor(spark, path, vec).collect()}
    assert report["table papers"] and not report["no vector missing"] and not report["no vector extra"]


def test_plans_and_manifests():
    assert corpus.years("2020, 2022-2024,2023") == [2020, 2022, 2023, 2024]
    for bad in ("", "20", "2024-2020", "1800"):
        with pytest.raises(ValueError):
            corpus.years(bad)
    assert corpus.plan({"iclr": "2024", "KDD": "2023"}) == [("KDD", 2023, "dblp"), ("ICLR", 2024, "official_json")]
    m = corpus.Manifest("add", {"api_key": "s", "venue": "ICLR"})
    m.step("prepare", n=3)
    assert m.finish(["x"]) == 1 and m.as_dict()["settings"] == {"api_key": "***", "venue": "ICLR"}
