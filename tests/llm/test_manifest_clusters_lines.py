"""Merkle manifest, centroid clustering and line dedup against plain-Python versions of their contracts."""

import hashlib
import math
import os
import zlib

import pytest

from listenlake.llm import centroids, lines, merkle

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# --- Merkle manifest -------------------------------------------------------------------------

def brute_manifest(rows):
    """Leaf, subroot, root, proof and folded root of every row, straight from the contract."""

    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return H(enc(r["doc_id"]) + enc(r["source"]) + enc(r["lang"]) + enc(r["n_chars"]) + enc(text))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([H("".join(below[i:i + 16])) for i in range(0, len(below), 16)])
        return levels

    def path(levels, t):
        out = []
        for level in levels[:-1]:
            s = t - t % 16
            out.append((level[s:t], level[t + 1:s + 16]))
            t //= 16
        return out

    items = [dict(r, leaf=leaf(r, r["text"])) for r in rows]
    sources = sorted({r["source"] for r in items}, key=lambda s: (s is not None, s or ""))
    trees, order = {}, {}
    for s in sources:
        mine = sorted([r for r in items if r["source"] == s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"]))
        order[s] = mine
        trees[s] = tree([r["leaf"] for r in mine])
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for si, s in enumerate(sources):
        for t, r in enumerate(order[s]):
            steps = path(trees[s], t) + path(top, si)
            tamper = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None
            node = leaf(r, r["text"].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if tamper else r["leaf"]
            for left, right in steps:
                node = H("".join(left) + node + "".join(right))
            proof = H("".join("".join(a) + "".join(b) for a, b in steps))
            out.append((r["doc_id"], r["leaf"], trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def manifest_rows(df, depth=merkle.LEVELS):
    got = merkle.manifest(df, depth).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted([tuple(r) for r in got], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def crafted_docs():
    rows = [
        (1, "Hello World", "en", "a", 11), (2, None, None, "a", None), (3, "", "en", None, 0), (None, "No id", "en", "a", 5),
        (4, "Über ÄÖ", "de", "ä", 7), (4, "Über ÄÖ", "de", "ä", 7), (5, "x" * 100_000, "en", "b", 100_000), (6, "lone", "fr", "c", 4),
    ]
    rows += [(100 + i, f"Text Number {i}", "en", "big", 14) for i in range(300)]
    return rows


def test_manifest_equals_the_contract_on_crafted_rows(spark):
    rows = crafted_docs()
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "7 as g", "'x' as pos", "1 as _mk_part")
    want = brute_manifest([dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r)) for r in rows])
    assert manifest_rows(df) == want
    # Superblocks of 16 leaves: the source of 300 rows climbs through stored levels twice.
    assert manifest_rows(df, depth=1) == want
    assert any(not v for *_, v in want) and any(v for *_, v in want)


@needs_tables
def test_manifest_equals_the_contract_on_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_manifest([r.asDict() for r in df.collect()])
    assert manifest_rows(df, depth=1) == want


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


# --- Centroid clustering ---------------------------------------------------------------------

def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (H(f"3:{r[0]}") if r[0] is not None else "~", r[1]))[:k]
    cs = [list(v) for _, v in first]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cs]
            j = min(range(len(cs)), key=lambda j: (d[j], j))
            out.append((i, j, d[j]))
        return out

    for _ in range(rounds):
        got = assign()
        for j in range(len(cs)):
            members = [v for (_, v), (_, c, _) in zip(kept, got) if c == j]
            if members:
                cs[j] = [sum(col) // len(members) for col in zip(*members)]
    got = assign()
    per = {}
    for _, j, d in got:
        per[j] = per.get(j, 0) + d
    total = sum(per.values())
    return sorted((i, j, d, per[j], total, H(",".join(map(str, cs[j])))) for i, j, d in got)


def cluster_rows(df):
    out, _ = centroids.cluster_vectors(df)
    return sorted(tuple(r) for r in out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_clusters_equal_the_contract_on_crafted_vectors(spark):
    import random

    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) + (i % 3) for _ in range(64)]) for i in range(120)]
    rows += [(500, [0.25] * 64), (501, [0.25] * 64), (501, [0.25] * 64), (502, None), (503, [0.1] * 63),
             (504, [0.1] * 63 + [None]), (505, [0.1] * 63 + [float("nan")]), (506, [0.1] * 63 + [float("inf")]), (507, [-0.5] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "'old' as cluster", "1 as _cc_x")
    got = centroids.cluster_vectors(df)[0]
    assert "_cc_x" in got.columns and got.filter("_cc_x = 1").count() == got.count()
    assert cluster_rows(df) == brute_clusters(rows)


@needs_tables
def test_clusters_equal_the_contract_on_embeddings(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert cluster_rows(df) == brute_clusters([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_few_or_no_vectors(spark):
    few = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.5] * 64)]
    df = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    assert cluster_rows(df) == brute_clusters(few)
    assert cluster_rows(spark.createDataFrame([], "vec_id long, embedding array<double>")) == []


# --- Line dedup ------------------------------------------------------------------------------

def brute_lines(rows, least=10):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    docs = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 1:
                docs.setdefault(key(line), set()).add(i)
    frequent = {k for k, ids in docs.items() if len(ids) >= least}
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if key(x) not in frequent]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[3]))


def line_rows(df):
    got = lines.drop_frequent_lines(df).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    return sorted([tuple(r) for r in got], key=lambda x: (x[0] is not None, x[0] or 0, x[3]))


def test_lines_equal_the_contract_on_crafted_texts(spark):
    menu = "Home | About\r"
    rows = [(i, f"{menu}\nBody {i}\n  HOME | about  \n\n") for i in range(9)]
    rows += [(9, "  home | ABOUT\t"), (9, "  home | ABOUT\t"), (10, None), (11, ""), (12, "\n\n"), (None, "Home | About\nnull id")]
    rows += [(13, "\n".join(["Shared Nine"] * 50_000 + ["own"])), (14, "   \n   ")]
    rows += [(20 + i, "Shared Nine\nx") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'keep' as n_lines", "7 as _ld_doc")
    want = brute_lines(rows)
    assert line_rows(df) == want
    # The menu is in eleven documents with the null id, the other line in nine.
    assert {r[0]: r[2] for r in want}[0] == 2 and {r[0]: r[2] for r in want}[13] == 0
    out = lines.drop_frequent_lines(df)
    assert out.filter("_ld_doc = 7").count() == len(rows) and "n_lines" in out.columns


@needs_tables
def test_lines_equal_the_contract_on_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert line_rows(df) == brute_lines([(r["doc_id"], r["text"]) for r in df.collect()])


def test_lines_of_nothing(spark):
    assert lines.drop_frequent_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
