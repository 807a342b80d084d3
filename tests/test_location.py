"""The cascade of names on a small gazetteer, and the similarity join against all pairs."""

import random
import re

import pytest

from stratiform.functions import text
from stratiform.operators import location

DISTRICTS = [(1, "Quận Cầu Giấy"), (2, "Quận Ba Đình"), (3, "Huyện Thạch Thất"), (4, "Quận Đống Đa"), (5, "Quận Hà Đông")]
WARDS = [(10, "Phường Dịch Vọng", 1), (11, "Phường Dịch Vọng Hậu", 1), (12, "Phường Cầu Giấy", 1), (13, "Xã Đại Đồng", 3), (14, "Phường Láng Hạ", 4), (15, "Phường Trung Hòa", 1), (16, "Phường Trung Hòa", 5), (17, "Phường Mộ Lao", 5)]
CITIES = [(0, "Hà Nội")]


@pytest.fixture(scope="module")
def places(spark):
    return (
        spark.createDataFrame(WARDS, "ward_id long, ward_name string, district_id long"), spark.createDataFrame(DISTRICTS, "district_id long, district_name string"),
        spark.createDataFrame(CITIES, "city_id long, city_name string"),
    )


def _resolved(spark, places, asked):
    df = spark.createDataFrame(asked, "hint string, scope string")
    return {(r["hint"], r["scope"]): r for r in location.resolve(df, *places, home=0).collect()}


def test_cascade(spark, places):
    want = {
        ("Hà Nội", None): ("exact", "city", 0), ("hà  NỘI", "ward"): ("exact", "city", 0), ("đâu đó", "city"): ("exact", "city", 0),
        ("quận Cầu Giấy", None): ("exact", "district", 1), ("cau giay", None): ("exact", "district", 1), ("cau giay", "ward"): ("exact", "ward", 12), ("phường Cầu Giấy", None): ("exact", "ward", 12),
        ("huyen thac that", None): ("fuzzy", "district", 3), ("my dinh", None): ("not_found", "not_found", None), ("my dinh", "district"): ("not_found", "not_found", None),
        ("huyện Thạch Thất", "district"): ("exact", "district", 3), ("Đống Đa", "district"): ("exact", "district", 4), ("đại đồng", None): ("exact", "ward", 13), ("Đại Đồng", "district"): ("not_found", "not_found", None),
        ("Trung Hòa, Hà Đông", None): ("exact", "ward", 16), ("trung hoa, quan cau giay", "ward"): ("exact", "ward", 15), ("Trung Hà, Hà Đông", "ward"): ("fuzzy", "ward", 16),
        ("láng hạ, nowhere", None): ("exact", "ward", 14), ("trung hoa", "ward"): ("exact", "ward", 15), (", cầu giấy", "district"): ("fuzzy", "district", 1), ("láng hà", "ward"): ("exact", "ward", 14),
        ("", None): ("not_found", "not_found", None), (None, "ward"): ("not_found", "not_found", None), ("qqqqq", "ward"): ("not_found", "not_found", None),
    }
    got = _resolved(spark, places, list(want) + [("cau giay", None)])
    assert {k: (r["status"], r["level"], r["place_id"]) for k, r in got.items()} == want
    assert [k for k, r in got.items() if r["collision"]] == [("cau giay", None)]
    assert got["cau giay", None]["score"] == 1.0 and 0.5 <= got["huyen thac that", None]["score"] < 1


def test_several_candidates_best_first(spark, places):
    r = _resolved(spark, places, [("phường dịch vọn", None), ("trung hoaa", "ward")])
    many = r["phường dịch vọn", None]
    assert (many["status"], many["level"], many["place_id"], many["candidates"]) == ("multiple", "ward", None, [10, 11])
    assert r["trung hoaa", "ward"]["candidates"][:2] == [15, 16]
    asked = spark.createDataFrame([(17, "trung hoaa", "ward"), (None, "trung hoaa", "ward"), (99, "Mộ Lao", None), (None, None, None)], "ward_id long, hint string, scope string")
    got = {(r["ward_id"], r["hint"]): (r["status"], r["level"], r["place_id"]) for r in location.auto_resolve(asked, *places).collect()}
    assert got == {(17, "trung hoaa"): ("exact", "ward", 17), (None, "trung hoaa"): ("needs_clarification", "ward", None), (99, "Mộ Lao"): ("exact", "ward", 17), (None, None): ("error", None, None)}


def test_search_goes_over_leaves_and_groups(spark, places):
    words = spark.createDataFrame([("quận hà đông",), ("dịch vọng",)], "keyword string")
    got = {}
    for r in sorted(location.search(words, places[0], places[1]).collect(), key=lambda r: (-r["score"], -r["district_score"], r["ward_id"])):
        got.setdefault(r["keyword"], []).append(r["ward_id"])
    assert set(got["quận hà đông"]) >= {16, 17} and got["dịch vọng"][:2] == [10, 11]


def _grams(name):
    return {("  " + w + " ")[i : i + 3] for w in re.findall(r"[^\W_]+", name.lower()) for i in range(len(w) + 1)}


@pytest.mark.parametrize("limit", [0.3, 0.5, 0.8, 1.0])
def test_the_similarity_join_finds_all_pairs(spark, limit):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 6)))
    names = ["common " + " ".join(word() for _ in range(rng.randint(0, 3))) for _ in range(120)] + ["", "common", "x"]
    terms = [n[:-1] for n in names[:60]] + names[60:] + [None, "zzz"]
    near = lambda a, b: len(_grams(a) & _grams(b)) / len(_grams(a) | _grams(b)) if _grams(a) | _grams(b) else 0.0
    want = {(t, n) for t in terms if t is not None for n in names if near(t, n) >= limit}
    got = location.similar(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(n,) for n in names], "name string"), limit)
    rows = got.collect()
    assert {(r["term"], r["name"]) for r in rows} == want and len(rows) == len(want)
    assert all(r["score"] == pytest.approx(near(r["term"], r["name"])) for r in rows)


def test_common_grams_join_nothing(spark):
    """Names that share a word and nothing else do not meet by it: the join's rows are few against those of all shared grams."""
    names = spark.createDataFrame([(f"street {i * 7919:06d} {chr(97 + i % 26) * 5}{i:03d}",) for i in range(300)], "name string")
    found = location.similar(names.withColumnRenamed("name", "term"), names, 0.8)
    assert found.count() == 300
    assert text.similarity_sql("a", "b")  # the oracle's own form, over all pairs
