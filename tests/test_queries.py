"""Every query with SQL against that SQL, at the smallest scale."""

import collections
import datetime
import glob
import hashlib
import itertools
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from framelake.plans.fixtures import SPLITS, manifest, with_split
from framelake.plans.oracle import ORACLE
from framelake.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, datetime.datetime):
        return str(v)
    return round(float(v), 5)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    rel = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_leakage_report_without_sql(spark):
    found = QUERIES["leakage_report"](spark, SF).collect()
    near = [r for r in found if r["match_type"] == "near"]
    # by hand: rows of the first split choose in order, the nearest partner that is left
    held = with_split(spark, SF).filter("phash <> ''").select("row_idx", "path", "phash", "split").orderBy("row_idx").collect()
    splits = collections.defaultdict(set)
    for r in held:
        splits[r["phash"]].add(r["split"])
    used, want = {r["path"] for r in held if len(splits[r["phash"]]) > 1}, {}
    for a, b in itertools.combinations(SPLITS, 2):
        before = set(used)
        for r in (r for r in held if r["split"] == a and r["path"] not in before):
            near_by = []
            for q in (q for q in held if q["split"] == b and q["path"] not in used and q["phash"] != r["phash"]):
                d = (int(r["phash"], 16) ^ int(q["phash"], 16)).bit_count()
                if d <= 8 and {r["phash"][k : k + 16] for k in range(0, 64, 16)} & {q["phash"][k : k + 16] for k in range(0, 64, 16)}:
                    near_by.append((d, hashlib.md5(f"{r['path']}|{q['path']}".encode()).hexdigest(), q["path"]))
            if near_by:
                want[r["path"]] = min(near_by)[2]
                used |= {r["path"], min(near_by)[2]}
    assert want and {r["path"]: r["matched_path"] for r in near} == want
    used = [p for r in near for p in (r["path"], r["matched_path"])]
    exact = {r["path"] for r in found if r["match_type"] == "exact"}
    assert len(used) == len(set(used)) and not exact & set(used)


def test_exact_recall_finds_what_the_cap_skips(spark, tmp_path):
    """Over 500 rows of one hash, and every pair at threshold 8, against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same = spark.range(10_000, 10_900).selectExpr("id as doc_id", "'one short text' as text", "'en' as lang", "'web' as source", "14 as n_chars")
    docs.unionByName(same.select(*[same[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])).write.parquet(f"{tmp_path}/documents.parquet")
    held = [(r["row_idx"], int(r["phash"], 16)) for r in manifest(spark, str(tmp_path)).filter("phash <> '' and not is_corrupt").orderBy("row_idx").collect()]
    first: dict = {}
    for k, h in held:
        first.setdefault(h, k)
    nodes = [(k, h) for h, k in first.items()]
    want = {(min(a, b), max(a, b), (g ^ h).bit_count()) for i, (a, g) in enumerate(nodes) for b, h in nodes[:i] if (g ^ h).bit_count() <= 8}
    want |= {(first[h], k, 0) for k, h in held if first[h] != k}
    got = QUERIES["near_dup_pairs_exact_8"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    clusters = {r["row_idx"]: r["cluster"] for r in QUERIES["near_dup_clusters_exact_8"](spark, str(tmp_path)).collect()}
    copies = [k for k, _ in held if k >= 10_000]
    assert len(copies) > 500 and len({clusters[k] for k in copies}) == 1
