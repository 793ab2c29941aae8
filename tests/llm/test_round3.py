"""The n-gram join, the Merkle manifest and the filter audit against brute force, and their defined cases."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.llm import common, filter_audit, merkle, ngram_join, setgroups

from .test_llm import BLANK, ODD, lower
from .test_llm import docs, empty, no_labels, odd  # noqa: F401

# 11 -----------------------------------------------------------------------------------------------------------------


def grams(text, size):
    w = re.findall(BLANK, lower(text or ""))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_join(texts, size=3, percent=90):
    sets = {i: grams(t, size) for i, t in texts.items()}
    where, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for ids in where.values():
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


def joined(rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows.collect()}


def test_ngram_join(spark, sf, docs):  # noqa: F811
    assert joined(ngram_join.join_similar(common.documents(spark, sf))) == brute_join({i: r.text for i, r in docs.items()})


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (2, 75), (3, 60)])
def test_ngram_join_in_a_group_of_edits(spark, size, percent, monkeypatch):
    """Chains of edits around the threshold, in groups of a few sets so that most links cross groups."""
    monkeypatch.setattr(setgroups, "GROUP_SETS", 4)
    monkeypatch.setattr(setgroups, "BLOCK_SETS", 4)
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(150)]
    texts = {}
    for i in range(160):
        words = (base if i < 30 else texts[int(rng.integers(0, i))].split())[:]
        for k in rng.integers(0, len(words), size=int(rng.integers(1, 4))):
            words[k] = f"e{int(rng.integers(0, 40))}"
        texts[i] = " ".join(words)
    texts |= {1000 + k: " ".join(f"u{j}" for j in range(k)) for k in range(12)}  # sets around the least that can link
    texts[2000] = texts[3].upper()
    want = brute_join(texts, size, percent)
    got = joined(ngram_join.join_similar(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), percent, size))
    assert got == want and 1 < len({c for _, c in want.values()}) < len(texts)


def test_ngram_join_of_one_hot_passage(spark):
    """A long passage in every text, and a group of many copies with an edit each."""
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"{passage} " + " ".join(f"x{k}y{j}" for j in range(20))) for k in range(300)]
    words = [f"c{k}" for k in range(200)]
    rows += [(1000 + k, " ".join(words[:k] + ["changed"] + words[k + 1 :])) for k in range(200)]
    got = joined(ngram_join.join_similar(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute_join(dict(rows))
    assert {c for _, c in got.values()} == {*range(300), 1000}


def test_ngram_join_of_odd_rows(spark, odd, empty):  # noqa: F811
    found = ngram_join.join_similar(odd).collect()
    assert Counter(r.doc_id for r in found) == Counter(x[0] for x in ODD)
    by_id = {r.doc_id: r for r in found}
    assert by_id[6].component_id == by_id[5].component_id == 5 and by_id[9].component_id == 9
    assert (by_id[1].n_shingles, by_id[1].component_id, by_id[2].component_id) == (0, 1, 2)
    assert by_id[None].component_id is None
    assert ngram_join.join_similar(empty).count() == 0
    # one id with two texts, each of which links with another document
    a, b = (" ".join(f"{x}{k}" for k in range(80)) for x in "ab")
    rows = spark.createDataFrame([(5, a), (5, b), (6, a + " end"), (7, b + " end"), (4, "else")], "doc_id long, text string")
    found = Counter((r.doc_id, r.component_id) for r in ngram_join.join_similar(rows).collect())
    assert found == Counter({(5, 5): 2, (6, 5): 1, (7, 5): 1, (4, 4): 1})


def test_members_bound_and_open():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, size=40)) for _ in range(9)]
    row = {"sets": [{"id": k, "size": len(s), "tokens": s.tolist()} for k, s in enumerate(sets)]}
    members = setgroups._members(row)
    for _ in range(30):
        asked = np.unique(rng.integers(0, 80, size=45))
        bound, low = members.overlaps(asked)
        shared = [len(np.intersect1d(asked, s)) for s in sets]
        assert bound == len(np.intersect1d(asked, np.unique(np.concatenate(sets)))) >= max(shared)
        assert members.shared(asked, low).tolist() == shared
        want = [k for k, s in enumerate(sets) if 100 * shared[k] >= 50 * (len(s) + len(asked) - shared[k])]
        assert members.linked(len(asked), asked, 50).tolist() == want


# 12 -----------------------------------------------------------------------------------------------------------------


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(nodes):
    """All levels up to the root."""
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def brute_path(levels, k):
    path = []
    for nodes in levels[:-1]:
        run, at = nodes[k & ~7 : (k & ~7) + 8], k & 7
        path.append((run[:at], run[at + 1 :]))
        k >>= 3
    return path


def brute_manifest(rows):
    """doc_id, leaf -> subroot, root, proof, folded root, verified; rows are (doc_id, text, lang, source, n_chars)."""
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0], brute_leaf(r, r[1]), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for x in langs:
        by_lang[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append(brute_tree([r[1] for r in by_lang[x]]))
    top = brute_tree([t[-1][0] for t in trees])
    out = []
    for j, (x, tree) in enumerate(zip(langs, trees, strict=True)):
        for k, (i, leaf, r) in enumerate(by_lang[x]):
            path = brute_path(tree, k) + brute_path(top, j)
            touched = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
            node = brute_leaf(r, lower(r[1])) if touched and r[1] is not None else leaf
            for before, after in path:
                node = H(*before, node, *after)
            proof = H(*(s for before, after in path for s in before + after))
            out.append((i, leaf, tree[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return Counter(out)


def found_manifest(rows):
    return Counter(tuple(r) for r in merkle.proofs(*merkle.manifest(rows)).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_manifest(spark, sf, docs):  # noqa: F811
    want = brute_manifest([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in docs.values()])
    assert found_manifest(common.documents(spark, sf)) == want
    assert len({r[6] for r in want}) == 2


def test_manifest_of_trees_of_all_heights(spark):
    """Sizes around the powers of eight and of a stored subtree, and more languages than one run holds."""
    rows, at = [], 0
    for j, n in enumerate((1, 2, 7, 8, 9, 64, 65, 511, 512, 513, 1)):
        for _ in range(n):
            rows.append((at * 7 % 1619 - 5, f"Text {at}", f"l{j}" if j else "", None, at))
            at += 1
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert found_manifest(spark.createDataFrame(rows, schema)) == brute_manifest(rows)


def test_manifest_of_three_stored_levels(spark):
    """One leaf more than two stored subtrees' worth, 512 * 512."""
    n = 512 * 512 + 1
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("A").alias("text"), F.lit("en").alias("lang"),
                                 F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    below, above = merkle.manifest(rows)
    assert len(below.stored) == 3
    some = [0, 1, 7, 8, 4095, 262_143, 262_144]
    found = merkle.proofs(below, above).where(F.col("doc_id").isin(some)).collect()
    tree = brute_tree([brute_leaf((k, "A", "en", "s", 1), "A") for k in range(n)])
    for r in found:
        path = brute_path(tree, r.doc_id)
        assert r.root == r.subroot == tree[-1][0]
        assert r.proof_sha256 == H(*(s for before, after in path for s in before + after))
    assert len(found) == len(some) and {r.verified for r in found} == {True, False}


def test_manifest_of_odd_rows(spark, odd, empty):  # noqa: F811
    assert found_manifest(odd) == brute_manifest(ODD)
    assert merkle.proofs(*merkle.manifest(empty)).count() == 0
    lone = spark.createDataFrame([(3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = merkle.proofs(*merkle.manifest(lone)).collect()
    assert row.root == row.subroot == row.leaf == row.folded_root and row.proof_sha256 == H() and row.verified


# 13 -----------------------------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    """rows are (doc_id, text, lang, ...), labels (doc_id, quality, toxic)."""
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    parts = defaultdict(list)
    for r in rows:
        text = r[1] or ""
        w = re.findall(BLANK, text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": r[0] is not None and first[text] < r[0]}
        parts[r[2] or ""].append(({x for x, f in fails.items() if f}, r[0] in good, r[0] in toxic))
    out = {}
    for part, marks in parts.items():
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                here = [m for m in marks if not m[0] & set(order[:k])]
                gone = [m for m in here if x in m[0]]
                total[x] += len(gone)
                out[part, order, k + 1] = [len(here) - len(gone), len(gone), sum(x in m[0] for m in marks) - len(gone),
                                           sum(m[0] == {x} for m in marks), sum(m[1] for m in gone), sum(m[2] for m in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(total[order[k - 1]])
    return out


FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def found_audit(rows, labels):
    got = filter_audit.audit(rows, labels).collect()
    out = {(r.part, r.filter_order, r.step): [r[c] for c in FIELDS] for r in got}
    assert len(out) == len(got) and all(r.filter == r.filter_order[r.step - 1] for r in got)
    return out


def test_audit(spark, sf, docs):  # noqa: F811
    labels = common.labels(spark, sf)
    want = brute_audit([(r.doc_id, r.text, r.lang) for r in docs.values()],
                       [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert found_audit(common.documents(spark, sf), labels) == want


def test_audit_of_odd_rows(spark, odd, empty, no_labels):  # noqa: F811
    marks = [(9, 1, 0), (9, 0, 1), (4, 1, None), (5, None, 1), (None, 1, 1), (77, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    assert found_audit(odd, labels) == brute_audit(ODD, [m for m in marks if m[0] is not None])
    assert found_audit(odd, no_labels) == brute_audit(ODD, [])
    assert filter_audit.audit(empty, no_labels).count() == 0
    assert merkle.leaves(odd).count() == len(ODD)


def test_positional_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 100, 1001):
        words = rng.integers(0, 1 << 32, size=n, dtype=np.uint32)
        want = [int((words >> np.uint32(k) & np.uint32(1)).sum()) for k in range(32)]
        assert filter_audit.positional_counts(words).tolist() == want


def test_survival_word(spark):
    rows = spark.range(32).select("id", *[F.expr(f"id >> {k} & 1 = 1").alias(f"f{k}") for k in range(5)])
    for r in rows.select("id", filter_audit.survival_word([F.col(f"f{k}") for k in range(5)]).alias("w")).collect():
        assert all((r.w >> s & 1 == 1) == (s & r.id == 0) for s in range(32))
