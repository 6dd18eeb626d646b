"""The Merkle manifest against a plain tree, with nulls, repeats, long texts, one-leaf groups and many groups."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import merkle_manifest
from shelfwise.llm.oracle import ORACLE
from shelfwise.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, n_chars):
    doc_id, text, lang, source, _ = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def plain(rows):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        leaves = []
        for r in groups[g]:
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            leaves.append((-(2**70) if r[0] is None else r[0], leaf(r, r[4]), r[0], leaf(r, r[4] + 1 if tampered else r[4])))
        leaves.sort(key=lambda x: x[:2])
        made[g] = (leaves, plain_tree([x[1] for x in leaves]))
    top = plain_tree([made[g][1][-1][0] for g in order])
    out = []
    for n, g in enumerate(order):
        leaves, levels = made[g]
        for i, (_, own, doc_id, claim) in enumerate(leaves):
            proof, cur = [], claim
            for tree, at in ((levels, i), (top, n)):
                for nodes in tree[:-1]:
                    other = nodes[at ^ 1] if at ^ 1 < len(nodes) else None
                    cur = h(cur) if other is None else h(other, cur) if at % 2 else h(cur, other)
                    proof += [other] if other else []
                    at //= 2
            out.append((doc_id, own, levels[-1][0], top[-1][0], h(*proof), cur, cur == top[-1][0]))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i * 3, f"text {i} ž", "en", "s", rng.randrange(99)) for i in range(700)]
    out += [(i, "x" * i, "de", None, None if i % 5 == 0 else i) for i in range(257)]
    out += [(i, None, f"l{i}é", "s", i) for i in range(20)] + [(1, "", "", "", 0), (2, "a" * 3_000_000, "fr", "s", 3)]
    out += [(None, "n", None, None, 5), (None, None, None, None, None), (7, "same", None, "s", 2**63 - 1)]
    return out + [(7, "same", "en", "s", 4)] * 3 + [(14, "one", "en", "s", 1), (14, "two", "en", "s", 1), (14, "two", "en", "s", 1)]


def query(spark, rows, folder):
    rng = random.Random(1)
    spark.createDataFrame(rng.sample(rows, len(rows)), DOCS).repartition(5).write.parquet(f"{folder}/documents.parquet")
    return QUERIES["op11_merkle_manifest"](spark, str(folder))


def test_query_is_the_plain_tree(spark, rows, tmp_path):
    got = sorted((tuple(r) for r in query(spark, rows, tmp_path).collect()), key=repr)
    assert got == plain(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_one_group(spark, n, tmp_path):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(n)]
    got = sorted((tuple(r) for r in query(spark, rows, tmp_path).collect()), key=repr)
    assert got == plain(rows)


def test_empty_table(spark, tmp_path):
    df = query(spark, [], tmp_path)
    assert df.count() == 0 and "proof_sha256" in df.columns


def test_stored_levels_and_proofs(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumns({"g": F.lit("x"), "node": F.lit(1), "pos": F.lit(2), "root": F.lit(3)})
    manifest = merkle_manifest.build(docs, every=2)
    assert len(manifest.groups.stored) == 5  # 703 leaves of the largest group: levels 0, 2, 4, 6, 8
    assert all(len(r["items"]) <= 4 for t in manifest.groups.stored for r in t.collect())
    found = merkle_manifest.verify(manifest).collect()
    assert len(found) == len(rows) and all(r["verified"] and r["folded_root"] == manifest.root for r in found)
    assert all(h(*r["proof"]) == r["proof_sha256"] for r in found)
    assert {r["leaf"] for r in found} == {leaf(r, r[4]) for r in rows}


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = QUERIES["op11_merkle_manifest"](spark, folder)
    want = con.sql(ORACLE["op11_merkle_manifest"])
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
