"""Each operator against brute force, round trips or held-out accuracy, and its defined cases."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from flowgauge.llm import (
    common,
    fingerprint,
    license,
    linededup,
    minhash,
    packing,
    pieces,
    quality,
    sharding,
    token_orc,
    tokens,
    toxicity,
)

BLANK = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="session")
def docs(spark, sf):
    """Whole texts of a small table, one copy in memory for brute force."""
    return {r.doc_id: r for r in common.documents(spark, sf).collect()}


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "one two", "en", "a", 7),
    (4, "word " * 3000, "en", "a", 15000),
    (5, "One two three four five six. Seven eight nine ten eleven twelve thirteen fourteen.", "de", None, 1),
    (6, "One two three four five six. Seven eight nine ten eleven twelve thirteen fourteen.", "en", "b", 1),
    (7, "é漢🙂 \n\n\t \r\n ß İ", "fr", "b", 1),
    (None, "no id here", "en", "b", 1),
    (9, "same row", "en", "b", 1),
    (9, "same row", "en", "b", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names could clash."""
    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.withColumns({c: F.lit("x") for c in (
        "n_words", "kept", "m", "row", "key", "bucket", "label", "score", "ids", "spans", "_spans", "_measures", "digest",
        "_id", "_later", "_shard", "_key", "id", "good", "stratum", "token", "part", "tree", "node", "word")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


# 1 ------------------------------------------------------------------------------------------------------------------


def bag(text):
    return Counter(re.findall(BLANK, lower(text))) or Counter({"": 1})


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def test_fingerprints(spark, sf, docs):
    found = {r.doc_id: r for r in fingerprint.edited_fingerprints(common.documents(spark, sf)).collect()}
    order = sorted(docs, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    assert set(found) == set(docs)
    errors, marks = [], defaultdict(set)
    for i, r in found.items():
        text, head = docs[i].text, docs[after[i]].text
        half = len(text) // 2
        edited = text[: len(text) - half] + head[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors.append((r.near_edited - jaccard(bag(text), bag(edited)), r.near_next - jaccard(bag(text), bag(head))))
        marks[text].add(r.fingerprint)
    errors = np.array(errors)
    assert all(len(m) == 1 for m in marks.values())
    assert np.abs(errors.mean(axis=0)).max() < 0.02
    assert np.sqrt((errors**2).mean(axis=0)).max() < 0.08  # about sqrt(J (1 - J) / 64)


def test_fingerprints_of_repeated_rows(spark):
    """Two ids with many rows each: what is joined is one row of each."""
    rows = spark.range(4000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("some text "), F.col("id") % 2).alias("text"))
    found = fingerprint.edited_fingerprints(rows).collect()
    assert Counter(r.doc_id for r in found) == {0: 2000, 1: 2000} and len(set(found)) == 2


def test_passed_over_samples_differ_by_text(spark, monkeypatch):
    """Where all terms of a sample are passed over, unlike texts do not agree and equal ones do."""
    monkeypatch.setattr(fingerprint, "LEAST_CHANCE", 0.0)
    rows = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "a b c")], "doc_id long, text string")
    by_id = {r.doc_id: r for r in fingerprint.edited_fingerprints(rows).collect()}
    assert by_id[1].fingerprint == by_id[3].fingerprint and by_id[2].near_next == 0


def test_fingerprints_of_odd_rows(spark, odd, empty):
    found = fingerprint.edited_fingerprints(odd).collect()
    assert Counter(r.doc_id for r in found) == Counter(x[0] for x in ODD)
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].fingerprint == by_id[2].fingerprint != by_id[3].fingerprint
    assert by_id[5].fingerprint == by_id[6].fingerprint and by_id[4].n_chars == 15000
    assert by_id[1].edited_sha256 == hashlib.sha256(b"").hexdigest()
    assert fingerprint.edited_fingerprints(empty).count() == 0


# 2 ------------------------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = re.findall(BLANK, lower(text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_groups(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
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
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates(spark, sf, docs):
    found = minhash.near_duplicate_groups(common.documents(spark, sf)).collect()
    want = brute_groups({i: r.text for i, r in docs.items()})
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found) and len(found) == len(docs)


def test_near_duplicates_in_a_group_of_edits(spark):
    """A group whose members are linked by chains and stand around the threshold."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    pool = [f"e{k}" for k in range(60)]
    texts = {}
    for i in range(150):
        words = (base if i < 40 else texts[int(rng.integers(0, i))].split())[:]
        for k in rng.integers(0, len(words), size=int(rng.integers(1, 5))):
            words[k] = str(rng.choice(pool))
        texts[i] = " ".join(words)
    found = minhash.near_duplicate_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    want = brute_groups(texts)
    assert got == want and 1 < len({c for _, c in want.values()}) < 150


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(50, 49), (49, 60), (60, 48), (7, 7)]
    found = minhash.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.label for r in found} == {k: 0 for k in range(31)} | {k: 48 for k in (48, 49, 50, 60)}


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    found = minhash.near_duplicate_groups(odd).collect()
    assert Counter(r.doc_id for r in found) == Counter(x[0] for x in ODD)
    by_id = {r.doc_id: r for r in found}
    assert by_id[6].component_id == 5 and not by_id[6].kept and by_id[5].kept
    assert by_id[1].kept and by_id[2].kept and by_id[1].n_shingles == 0
    assert by_id[None].kept and by_id[None].component_id is None
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert minhash.near_duplicate_groups(empty).count() == 0
    # one id with two texts, each of which is linked with another document
    a, b = (" ".join(f"{x}{k}" for k in range(80)) for x in "ab")
    rows = spark.createDataFrame([(5, a), (5, b), (6, a + " end"), (7, b + " end"), (4, "else")], "doc_id long, text string")
    found = Counter((r.doc_id, r.component_id) for r in minhash.near_duplicate_groups(rows).collect())
    assert found == Counter({(5, 5): 2, (6, 5): 1, (7, 5): 1, (4, 4): 1})


def test_recall_at_the_threshold(spark):
    """Many texts of one origin, each with a few edits, whose pairs stand around the threshold: links are not lost."""
    rng = np.random.default_rng(12)
    base = [f"w{k}" for k in range(100)]
    texts = {}
    for i in range(600):
        words = base[:]
        for k in rng.choice(100, size=int(rng.integers(1, 5)), replace=False):
            words[k] = f"e{int(rng.integers(0, 300))}"
        texts[i] = " ".join(words)
    found = minhash.near_duplicate_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    want = brute_groups(texts)
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert sum(got[i] == c for i, (_, c) in want.items()) >= 0.99 * len(texts)


# 3 ------------------------------------------------------------------------------------------------------------------


def brute_measures(text):
    w = re.findall(BLANK, text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(BLANK, line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = set()
    for k in range(len(w) - 7):
        if windows[tuple(w[k : k + 8])] > 1:
            cover.update(range(k, k + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_quality_measures(spark, sf, docs):
    for r in quality.judge(common.documents(spark, sf), common.labels(spark, sf)).collect():
        want = brute_measures(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_exact_binomial_tail():
    from math import comb

    for n, p, k in ((10, 0.3, 2), (50, 0.02, 0), (200, 0.05, 9), (7, 0.5, 7)):
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.tail(k, n, p) == pytest.approx(want)
    # a cutoff is certified only while the bound holds, and nothing is after the first that fails
    assert quality.certified(1000, [0, 0, 5, 0], 0.01, 0.05) == 2
    assert quality.certified(10, [0, 0], 0.01, 0.05) == 0


def test_quality_cutoffs(spark):
    """Symbol-laden bad texts are rejected where labels suffice; a stratum with few labels rejects nothing."""
    rng = np.random.default_rng(3)
    rows, marks = [], []
    for i in range(1200):
        bad = i % 4 == 0
        words = [f"{rng.integers(0, 10**9):x}" + ("$$$" if bad else "") for _ in range(40)]
        rows.append((i, " ".join(words), "xx" if i >= 1180 else "en", None, 1))
        marks.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert all(found[i].kept == (i % 4 > 0) for i in range(1180))
    assert all(found[i].kept for i in range(1180, 1200))
    kept = quality.keep_good(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.kept} and kept.columns == docs.columns


def test_quality_of_odd_rows(odd, empty, no_labels):
    found = quality.judge(odd, no_labels).collect()
    assert Counter(r.doc_id for r in found) == Counter(x[0] for x in ODD)
    assert all(r.base_failed for r in found if r.doc_id != 5 and r.doc_id != 6) and not any(r.kept for r in found)
    assert quality.judge(empty, no_labels).count() == 0
    assert quality.keep_good(odd, no_labels).columns == odd.columns


# 4 ------------------------------------------------------------------------------------------------------------------


def brute_units(text):
    """(start, end, words) of each unit: words are cut at blanks and stripped of ASCII signs."""
    words = [(m.start(), m.end(), lower(m[0]).strip("".join(map(chr, [*range(48), *range(58, 97), *range(123, 128)]))))
             for m in re.finditer(BLANK, text)]
    begins = [k for k, (a, _, _) in enumerate(words)
              if k == 0 or "\n" in text[words[k - 1][1] : a] or text[words[k - 1][1] - 1] in ".!?"
              or re.match("[A-ZÀ-Þ]", text[a])]
    out = []
    for x, y in zip(begins, begins[1:] + [len(words)], strict=True):
        end = words[y][0] if y < len(words) else len(text)
        out.append((words[x][0], end, tuple(w for _, _, w in words[x:y] if w)))
    return out


def chosen_runs(text, least):
    """First words of the runs of ``least`` words that have the smallest digest of some RUNS neighbours."""
    found = linededup.Windows([text.encode()], least)
    n = len(found.sums) - least
    keys = [int(found._of(np.array([k]), np.array([k + least]))[0]) for k in range(n)]
    chosen = set()
    for k in range(n - linededup.RUNS + 1):
        some = keys[k : k + linededup.RUNS]
        chosen.update(k + j for j, x in enumerate(some) if x == min(some))
    return chosen


def brute_repeats(texts, least):
    """Spans of each text: what the windows cover that an earlier text, or an earlier place of the text, has, too."""
    windows = {}
    for i, text in texts.items():
        words, pairs = brute_windows(text, least)
        windows[i] = words, sorted({*pairs, *((a, a + least) for a in chosen_runs(text, least))})
    first = {}
    for i in sorted(texts):
        words, pairs = windows[i]
        for a, b in pairs:
            first.setdefault(tuple(words[a:b]), (i, a))
    out = {}
    for i, text in texts.items():
        words, pairs = windows[i]
        cut = {k for a, b in pairs if first[tuple(words[a:b])] != (i, a) for k in range(a, b)}
        begins = [m.start() for m in re.finditer(BLANK, text)] + [len(text)]
        at = [a for a, _ in form_words(text)]
        spans = []
        for k in sorted(cut):
            start = begins[0] if k == 0 else at[k]
            end = len(text) if k == len(at) - 1 else begins[begins.index(at[k]) + 1]
            if spans and k - 1 in cut:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((start, end))
        out[i] = spans
    return out


def test_repeats(spark, sf, docs):
    some = {i: r.text for i, r in docs.items() if len(r.text) < 20_000}
    want = brute_repeats(some, linededup.MIN_WORDS)
    rows = common.documents(spark, sf).where(F.char_length("text") < 20_000)
    for r in linededup.repeats(rows).collect():
        assert [tuple(s) for s in r.spans] == want[r.doc_id]
        text, rest, at = docs[r.doc_id].text, "", 0
        for a, b in want[r.doc_id]:
            rest, at = rest + text[at:a], b
        assert r.text == rest + text[at:] and r.n_cut == len(text) - len(r.text)


def test_passage_inside_lines(spark):
    passage = " ".join(f"Sentence {k} has the words a{k} b{k} c{k} d{k}." for k in range(8))
    rows = [(1, f"Alpha beta gamma. {passage} Delta."), (2, f"quite other words {passage} and the rest"), (3, "Delta.")]
    found = {r.doc_id: r for r in linededup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].n_cut == 0 and found[3].n_cut == 0
    assert found[2].text == "quite other words and the rest"


def test_repeats_of_odd_rows(odd, empty):
    found = linededup.repeats(odd).collect()
    assert Counter(r.doc_id for r in found) == Counter(x[0] for x in ODD)
    cut = linededup.cut_repeats(odd, min_words=5)
    assert cut.columns == odd.columns
    by_id = {r.doc_id: r for r in cut.collect()}
    assert by_id[6].text == "" and by_id[5].text == ODD[4][1] and by_id[6].n_chars == 0 and by_id[1].text is None
    assert by_id[9].text == "same row"
    assert linededup.repeats(empty).count() == 0


def brute_windows(text, least):
    """(first word, end) of the shortest runs of whole units with ``least`` words, from each unit on and up to each one."""
    words, edges = [], [0]
    for _, _, form in brute_units(text):
        words += form
        edges.append(len(words))
    pairs = {(a, min(b for b in edges if b >= a + least)) for a in edges if a + least <= edges[-1]}
    pairs |= {(max(a for a in edges if a <= b - least), b) for b in edges if b >= least}
    return words, sorted(pairs)


def form_words(text):
    """(start, form) of the words with a form."""
    signs = "".join(map(chr, [*range(48), *range(58, 97), *range(123, 128)]))
    found = [(m.start(), lower(m[0]).strip(signs)) for m in re.finditer(BLANK, text)]
    return [(a, w) for a, w in found if w]


def test_repeats_are_earlier_passages(spark, sf, docs):
    """Every word cut is in a run that stands earlier; every window of units that does is cut, every long run in part."""
    some, least = sorted(docs)[:300], linededup.MIN_WORDS
    rows = common.documents(spark, sf).where(F.col("doc_id").isin(some))
    first, all_words = {}, {}
    long = least + linededup.RUNS - 1
    for i in some:
        words = all_words[i] = [w for _, w in form_words(docs[i].text)]
        for size in (least, long):
            for a in range(len(words) - size + 1):
                first.setdefault(tuple(words[a : a + size]), (i, a))
        for a, b in brute_windows(docs[i].text, least)[1]:
            first.setdefault((tuple(words[a:b]), "units"), (i, a))
    n_cut = 0
    for r in linededup.repeats(rows).collect():
        i, words = r.doc_id, all_words[r.doc_id]
        cut = {k for k, (a, _) in enumerate(form_words(docs[i].text)) if any(x <= a < y for x, y in r.spans)}
        runs = [a for a in range(len(words) - least + 1) if first[tuple(words[a : a + least])] != (i, a)]
        assert cut <= {k for a in runs for k in range(a, a + least)}
        for a, b in brute_windows(docs[i].text, least)[1]:
            assert first[tuple(words[a:b]), "units"] == (i, a) or cut.issuperset(range(a, b))
        for a in range(len(words) - long + 1):
            assert first[tuple(words[a : a + long])] == (i, a) or not cut.isdisjoint(range(a, a + long))
        n_cut += len(cut)
    assert n_cut


def test_passage_that_begins_inside_sentences(spark):
    """Twelve, 25 and 18 words around two full stops, and 60 words without any."""
    def words(n, name):
        return " ".join(f"{name}{k}" for k in range(n))

    passages = [f"{words(12, 'a')}. {words(25, 'b')}. {words(18, 'c')}", words(60, "d")]
    rows = [(2 * k + j, f"{words(20, f'x{j}')} {p} {words(20, f'y{j}')}.") for k, p in enumerate(passages) for j in (0, 1)]
    found = {r.doc_id: r for r in linededup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, p in enumerate(passages):
        assert found[2 * k].n_cut == 0
        (span,) = found[2 * k + 1].spans
        cut = rows[2 * k + 1][1][span[0] : span[1]]
        assert cut.strip() in p and len(cut.split()) >= linededup.MIN_WORDS


def test_names_that_occur_elsewhere_stay(spark):
    names = [f"Name{k}x" for k in range(40)]
    rows = [(k, f"{n} was here with others of the place {k}. {n} left") for k, n in enumerate(names)]
    rows += [(100, " ".join(names)), (101, "Mr. " + " ".join(names[::-1])), (102, "Quite so. " + " ".join(names))]
    found = {r.doc_id: r for r in linededup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100].n_cut == 0 and found[101].n_cut == 0
    assert found[102].text == "Quite so. "


# 5 ------------------------------------------------------------------------------------------------------------------


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    places, labels = [], set()
    for phrase, label in license.PHRASES:
        phrase = phrase.split()
        for k in range(len(words) - len(phrase) + 1):
            if words[k : k + len(phrase)] == phrase:
                places.append(k)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def test_licenses(spark, sf, docs):
    seen = Counter()
    for r in license.scan_licenses(common.documents(spark, sf)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(docs[r.doc_id].text)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        seen[r.labels] += 1
    assert len(seen) > 3


def test_license_variants(spark, odd, empty):
    mit = license.NOTICES[1][0].split()
    changed = mit[:9] + ["really"] + mit[9:]
    rows = [(1, " ".join(mit)), (2, "Foo " + " ".join(changed) + " bar"), (3, " ".join(mit[:6]) + " of other things"),
            (4, "Under the MIT License; under the mit-license. cc-by-nc"), (5, " ".join(reversed(mit)))]
    found = {r.doc_id: r for r in license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].labels == "mit" and found[1].score == 1 and found[1].n_base == 0
    assert found[2].labels == "mit" and 0.75 <= found[2].score < 1
    assert found[3].labels == "" and found[5].score == 0
    assert (found[4].n_base, found[4].base_labels, found[4].first_word, found[4].last_word) == (3, "cc-by-nc,mit", 0, 8)
    got = license.scan_licenses(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(x[0] for x in ODD)
    assert {(r.n_words, r.score, r.labels, r.first_word) for r in got if r.doc_id in (1, 2)} == {(0, 0.0, "", None)}
    assert license.scan_licenses(empty).count() == 0


# 6 ------------------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    found = toxicity.score_documents(common.documents(spark, sf), common.labels(spark, sf))
    rows = found.join(common.labels(spark, sf), "doc_id").where("held_out").select("score", "toxic", "predicted").collect()
    bad = np.array([r.score for r in rows if r.toxic == 1])
    good = np.array([r.score for r in rows if r.toxic == 0])
    assert (bad[:, None] > good[None, :]).mean() > 0.95
    assert (bad >= 0.3).mean() > 0.8 and (good >= 0.3).mean() < 0.03
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_toxic_sentence_is_found(spark):
    rng = np.random.default_rng(1)
    rows, marks = [], []
    for i in range(400):
        sentences = [" ".join(f"v{x}" for x in rng.integers(0, 200, size=6)) + "." for _ in range(5)]
        if i % 3 == 0:
            sentences[3] = f"Blé v1 {('awful', 'nasty')[i % 2]} v2."
        rows.append((i, " ".join(sentences), None, None, None))
        marks.append((i, 1, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for r in toxicity.score_documents(docs, labels).where("held_out").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == (r.doc_id % 3 == 0)
        if r.predicted:
            assert rows[r.doc_id][1][r.worst_start : r.worst_end].startswith("Blé v1 ")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 250 < kept.count() < 280


def test_toxicity_of_odd_rows(odd, empty, no_labels):
    found = toxicity.score_documents(odd, no_labels).collect()
    assert Counter(r.doc_id for r in found) == Counter(x[0] for x in ODD) and {r.score for r in found} == {0.0}
    assert toxicity.score_documents(empty, no_labels).count() == 0
    model = toxicity.Model(np.ones(1 << toxicity.BITS, dtype=np.float32), -4.0)
    assert [s[0] for s in model.score([b"", b" \n ", b"a b"])][:2] == [0.0, 0.0]


# 7, 9 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "cuts"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoder_is_the_library(name, cuts, docs):
    encoder = tokens.Encoder(public_tokenizers.path(name), cuts)
    rng = np.random.default_rng(4)
    signs = ["a", "b", "'", "'s", "'re", "'ll ", " ", "  ", "\n", "\t", "1", "23", "!", "é", "É", "×", "µ", "İ", "\xa0",
             "漢", "\r\n", "I'M", "don't", "<|endoftext|>", "²", "ß", "--", "'ve", "ſ", "\x1c", "\x85"]
    texts = ["".join(rng.choice(signs, size=rng.integers(0, 14))) for _ in range(5000)]
    texts += [r.text for r in list(docs.values())[:150]]
    for got, want in zip(encoder.encode(texts), encoder.whole(texts), strict=True):
        assert np.array_equal(got, want)


@pytest.mark.parametrize(("name", "cuts"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoder_is_the_untouched_library(name, cuts, docs):
    """Also where a text holds the string of an added token."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    texts = [f"{x}{t}{y}" for t in added for form in (t, t.upper(), t.lower()) for t in [form] for x in ("", "a ") for y in ("", " b")]
    texts += [r.text for r in list(docs.values())[:100]] + ["a <|endoftext|> b"]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.Encoder(path, cuts).encode(texts)] == want


def reference_ids(name, text, end):
    encoder = tokens.Encoder(public_tokenizers.path(name), "word")
    return [*encoder.whole([text or ""])[0].tolist(), end]


def test_packing(spark, sf, docs):
    found = packing.pack_documents(common.documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"), 1, 4096).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for i, rows in by_doc.items():
        ids = reference_ids("word_bpe_49k.json", docs[i].text, 1)
        rows.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in rows] == [
            (k, s, len(ids[s : s + 4096])) for k, s in enumerate(range(0, len(ids), 4096))]
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + 4096], dtype="<u4"))
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and sum(3 * r.length > 4096 for r in rows) <= 2
    assert len(by_sequence) <= 1.01 * sum(r.length for r in found) / 4096 + 1


def test_plan_on_counts():
    rng = np.random.default_rng(2)
    for capacity in (7, 60, 4096):
        lengths = np.minimum(capacity, 1 + rng.lognormal(np.log(capacity / 5), 1, size=3000).astype(int))
        counts = Counter(lengths.tolist())
        plan = packing.pack_plan(dict(counts), capacity)
        fill, used = Counter(), Counter()
        for length, low, count, first, offset in sorted(plan.steps, key=lambda s: s[4]):
            used[length] += count
            for k in range(first, first + count):
                assert fill[k] == offset
                fill[k] += length
        assert used == counts and max(fill.values()) <= capacity and len(fill) == plan.sequences
        assert plan.sequences <= 1.03 * lengths.sum() / capacity + 2
    assert packing.pack_plan({}, 10).steps == []


def test_single_large_pieces_go_in_pairs():
    assert packing.pack_plan({k: 1 for k in range(1981, 2001)}, 4096).sequences == 10
    assert packing.pack_plan({2000: 3, 1999: 1}, 4096).sequences == 2


def test_packing_of_odd_rows(odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    found = packing.pack_documents(odd, path, 1, 64).collect()
    assert Counter(r.doc_id for r in found if r.piece == 0) == Counter(x[0] for x in ODD)
    assert [r.length for r in found if r.doc_id in (1, 2)] == [1, 1]
    assert packing.pack_documents(empty, path, 1, 64).count() == 0


def test_numbers_of_a_hot_length(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
                                    F.lit(5).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    found = packing.pack(rows, 17).toPandas()
    assert len(found) == 5000 and found.groupby("sequence_id").size().max() == 3
    assert not found.duplicated(["sequence_id", "offset"]).any()


def test_token_files(spark, sf, docs, tmp_path):
    path = str(tmp_path / "tokens")
    token_orc.write_tokens(common.documents(spark, sf), path, public_tokenizers.path("byte_bpe_50k.json"), 2,
                           stripe_bytes=1 << 16, index_rows=1000)
    ids = {r.doc_id: r.ids for r in token_orc.read_tokens(spark, path).collect()}
    index = {r.doc_id: r for r in token_orc.token_index(token_orc.read_tokens(spark, path)).collect()}
    encoder, start = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), "byte"), 0
    for i in sorted(docs):
        want = [*encoder.whole([docs[i].text])[0].tolist(), 2]
        assert ids[i] == want
        assert (index[i].start, index[i].n_tokens) == (start, len(want))
        assert index[i].ids_crc32 == zlib.crc32(np.array(want, dtype="<u4"))
        start += len(want)
    some = token_orc.find_documents(spark, path, [3, 700])
    assert {r.doc_id for r in some.collect()} == {3, 700}
    assert "PushedFilters: [In(doc_id, [3,700])]" in some._jdf.queryExecution().toString()
    files = [f for f in os.listdir(path) if f.endswith(".orc")]
    assert files and all("zstd" in f for f in files)


def test_token_files_of_odd_rows(spark, odd, empty, tmp_path):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    for name, rows, n in (("odd", odd, len(ODD)), ("empty", empty, 0)):
        path = str(tmp_path / name)
        token_orc.write_tokens(rows, path, tokenizer, 2)
        found = token_orc.token_index(token_orc.read_tokens(spark, path)).collect()
        assert len(found) == n
        starts = sorted((r.start, r.n_tokens) for r in found)
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


# 8 ------------------------------------------------------------------------------------------------------------------


def test_pieces_by_chunks(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = pieces.Model.of(path).library
    rng = np.random.default_rng(6)
    signs = [*"abcdefghinorst", " ", "  ", "é", "漢", "🙂", "\n", "ing", "the", " the", "tion", "aaaa", "    ", "▁"]
    texts = ["".join(rng.choice(signs, size=rng.integers(0, 300))) for _ in range(60)]
    texts += ["a" * 500, "the" * 200, " " * 300, "ababab" * 60, "🙂漢" * 60, "internationalization" * 20, "", "a b"]
    texts += [r.text for r in list(docs.values())[:40]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for giant, chunk in ((0, 48), (100, 150)):
        found = pieces.encode(table, path, giant, chunk)
        found = found.withColumn("text", pieces.decode(F.col("ids"), path)).collect()
        assert len(found) == len(texts)
        for r in found:
            want = library.encode(texts[r.doc_id])
            assert r.ids == want and r.text == library.decode(want)
    plain = [t for t in texts if "▁" not in t]
    assert all(library.decode(library.encode(t)) == t for t in plain)


def test_scan_is_the_sequential_product():
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 6, size=12)
    matrices = [np.where(rng.random((a, b)) < 0.6, rng.normal(size=(a, b)), -np.inf)
                for a, b in zip(sizes, sizes[1:], strict=False)]
    running = matrices[0]
    for got, step in zip(pieces.scan(matrices), [None, *matrices[1:]], strict=True):
        running = running if step is None else pieces.combine(running, step)
        assert np.allclose(np.nan_to_num(got, neginf=-1e9), np.nan_to_num(running, neginf=-1e9))


def test_only_bpe_models():
    path = public_tokenizers.path("piece_bpe_32k.model")
    blob = pieces.Model.of(path).library.serialized_model_proto()
    assert pieces.model_type(blob) == pieces.BPE
    # settings that come later in a message replace earlier ones: 2 is BPE, 1 Unigram; nothing stated is Unigram
    assert pieces.model_type(blob + bytes([0x12, 2, 0x18, 1])) == 1 and pieces.model_type(b"") == 1


def test_pieces_of_odd_rows(odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.encode(odd, path).collect()
    assert Counter(r.doc_id for r in found) == Counter(x[0] for x in ODD)
    assert all(r.ids == [] for r in found if r.doc_id in (1, 2))
    assert pieces.encode(empty, path).count() == 0


# 10 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("round_bits", [2, 12])
def test_shards(spark, sf, docs, round_bits):
    limit = 60_000
    found = sharding.shard_rows(common.documents(spark, sf), limit, round_bits).collect()
    assert len(found) == len(docs)
    sizes, rows = Counter(), Counter()
    for r in found:
        assert r.bytes == len(docs[r.doc_id].text.encode()) and len(r.shard) == r.depth
        sizes[r.shard] += r.bytes
        rows[r.shard] += 1
    shards = sorted(sizes)
    # no shard is a prefix of another, all fit, and every parent was too large
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:], strict=False))
    assert all(sizes[s] <= limit or rows[s] == 1 for s in shards)
    for s in shards:
        assert not s or sum(n for t, n in sizes.items() if t.startswith(s[:-1])) > limit
    assert all((r.shard_bytes, r.shard_rows) == (sizes[r.shard], rows[r.shard]) for r in found)


def test_shards_of_a_hot_id(spark):
    rows = [(7, "x" * 100)] * 300 + [(k, "y" * 100) for k in range(50)]
    found = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 2000).collect()
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.bytes
    assert len(found) == 350 and max(sizes.values()) <= 2000 and all(r.fits for r in found)


def test_shards_of_odd_rows(spark, odd, empty, tmp_path):
    found = sharding.shard_rows(odd, 100).collect()
    assert Counter(r.doc_id for r in found) == Counter(x[0] for x in ODD)
    assert [r.fits for r in found if r.doc_id == 4] == [False]
    assert sharding.shard_rows(empty, 100).count() == 0
    sharding.write_shards(odd, str(tmp_path / "shards"), 100)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert set(back.columns) == {*odd.columns, "_shard_"}
    assert Counter(map(tuple, back.select(*odd.columns).collect())) == Counter(map(tuple, odd.collect()))


# pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf, docs):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "near_duplicates", "line_dedup", "packing"]
    labels = common.labels(spark, sf)
    rows = common.documents(spark, sf)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in rows.collect()}
        out = common.written(stage(spark, rows, sf), f"test-{name}")
        if name != "packing":
            assert out.columns == rows.columns
        kept[name] = SimpleNamespace(before=before, after=out.collect())
        if name == "quality_rules":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in quality.judge(rows, labels).where("kept").collect()}
        if name == "toxicity":
            gone = {r.doc_id for r in toxicity.score_documents(rows, labels).where("predicted = 1").collect()}
            assert {r.doc_id for r in out.collect()} == set(before) - gone
        rows = out
    step = kept["near_duplicates"]
    want = brute_groups({i: r.text for i, r in step.before.items()})
    assert {r.doc_id for r in step.after} == {i for i, (_, c) in want.items() if i == c}
    step = kept["line_dedup"]
    spans = brute_repeats({i: r.text for i, r in step.before.items()}, linededup.MIN_WORDS)
    assert any(spans.values())
    for r in step.after:
        text, at, rest = step.before[r.doc_id].text, 0, ""
        for a, b in spans[r.doc_id]:
            rest, at = rest + text[at:a], b
        assert r.text == rest + text[at:] and r.n_chars == len(r.text)
    step = kept["packing"]
    lengths = Counter()
    for r in step.after:
        lengths[r.doc_id] += r.length
    assert {i: len(reference_ids("word_bpe_49k.json", r.text, 1)) for i, r in step.before.items()} == dict(lengths)
