"""SimHash, substring deduplication and decontamination against brute force."""

import itertools
import re

import numpy as np
import public_tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import base, decontaminate, queries, simhash, substring


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet=st.sampled_from("aB É\x1c\x85\t\n　x"), max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_segments_find_every_pair(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(-(1 << 63), 1 << 63, 40)
    fps = {int(c) for c in centres}
    for c in centres:
        for k in range(12):
            flips = rng.choice(64, k % 7, replace=False)
            v = int(c) & (1 << 64) - 1
            for b in flips:
                v ^= 1 << int(b)
            fps.add(v - (1 << 64) if v >= 1 << 63 else v)
    want = {(a, b) for a, b in itertools.combinations(sorted(fps), 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for count in (2, 3, 4, 5):
        got = [tuple(r) for r in simhash.links(df, 4, count).collect()]
        assert len(got) == len(set(got)) and set(got) == want, count


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 8)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)}


def test_near_duplicates_against_all_pairs(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    fp = {d.doc_id: plain_fingerprint(d.text) for d in docs}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(fp, 2):
        if bin(fp[a] ^ fp[b]).count("1") <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = queries.op3_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", find(i)) for i in fp} and len(got) == len(docs)


def test_simhash_of_odd_rows(spark, odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {(r.fp, r.component_id) for r in got if r.doc_id in (1, 2, 3)} == {(0, 1)}
    assert {r.component_id for r in got if r.doc_id in (4, 9)} == {4}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8]  # the empty ones are one group, the null id among them
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def plain_words(text):
    return [w.lower() for w in re.findall(r"[^\W]+", text or "")]


def test_one_row_of_each_group_stays(spark):
    """Ids that several texts share, null ids and equal rows: exactly one row of each component."""
    rng = np.random.default_rng(8)
    a, b, c, d = (" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)) for _ in range(4))
    rows = [(5, a), (5, b), (6, b), (6, b), (None, c), (None, c), (7, d), (None, d), (8, a)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=lambda r: r[1]) == sorted([(5, a), (5, b), (None, c), (7, d)], key=lambda r: r[1])


def test_names_that_clash(spark):
    """Columns that already have an operator's names stay, and its own get others."""
    from corpusloom.llm import bpe, pieces, quality, toxicity

    docs = spark.createDataFrame([(1, "Some words here.", 1, 2, 3, 4, 5, 6)], "doc_id long, text string, score int, ids int, n_tokens int, fp int, statistics int, found int")
    bench = spark.createDataFrame([("i", "some words")], "item_id string, text string")
    path = public_tokenizers.path
    for got, new in (
        (toxicity.score(docs, toxicity.Model(-4.0, {})), "_score"), (pieces.token_counts(docs, path("byte_bpe_50k.json")), "_n_tokens"), (bpe.encode(docs, path("word_bpe_49k.json")), "_ids"),
        (quality.with_statistics(docs), "_statistics"), (simhash.with_fingerprint(docs), "_fp"), (decontaminate.occurrences(docs, bench), "_found"),
    ):
        row = got.first()
        assert got.columns[:8] == docs.columns and new in got.columns and tuple(row)[:8] == (1, "Some words here.", 1, 2, 3, 4, 5, 6) and row[new] is not None


def repeated_places(rows, size):
    """By comparing every window of `size` words with all earlier ones: the words that stand in one met before, but not in an overlapping one. rows: (doc_id, text) by rank."""
    seen, out = {}, {}
    for key, text in rows:
        words, hit = plain_words(text), set()
        for k in range(len(words) - size + 1):
            window = tuple(words[k : k + size])
            held, at = seen.setdefault(window, (key, k))
            if held != key or k >= at + size:
                hit.update(range(k, k + size))
        out[key] = hit
    return out


def removed_places(text, spans):
    """The numbers of the words inside the spans."""
    return {k for k, m in enumerate(re.finditer(r"\w+", text or "")) if any(a <= m.start() and m.end() <= b for a, b in spans)}


def test_substrings_against_brute_force(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want, text = repeated_places(rows, 50), dict(rows)
    got = {r.doc_id: r for r in substring.deduplicate(docs).collect()}
    assert set(got) == set(text)
    total = found = 0
    for key, r in got.items():
        gone = removed_places(text[key], r.removed)
        assert gone <= want[key]  # nothing goes that does not stand in an earlier place
        total, found = total + len(want[key]), found + len(gone)
        left = "".join(text[key][a:b] for a, b in zip([0, *(x[1] for x in r.removed)], [*(x[0] for x in r.removed), len(text[key])], strict=True))
        assert left.split() == r.text.split()
        assert r.removed or r.text == text[key]
    assert total and found >= 0.98 * total, (found, total)  # what is left is shared with a later holder only


def test_a_passage_at_any_offset_goes_whole(spark):
    """Each passage stands in three texts at any word; it stays in the first only, and nothing else goes."""
    rng = np.random.default_rng(11)
    kinds = ["word", "Word", "word.", "WORD", "日本語", "слово", "w-w", "(word)"]
    own = lambda: "".join(rng.choice(list("abcdefgh"), 8))
    word = lambda: rng.choice(kinds) + own()
    rows, want = [], {}
    for k in range(60):
        passage = [word() for _ in range(int(rng.integers(51, 140)))]
        for copy in range(3):
            before, after = ([own() for _ in range(rng.integers(0, 80))] for _ in range(2))
            rows.append((3 * k + copy, " ".join([*before, *passage, *after])))
            want[3 * k + copy] = " ".join([*before, *after]) if copy else rows[-1][1]
    got = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_a_line_and_the_same_words_inside_a_line_meet(spark):
    """30 words on a line of their own, and the same within longer lines, with a threshold of 25."""
    rng = np.random.default_rng(13)
    own = lambda n: [("".join(rng.choice(list("abcdefgh"), 8))) for _ in range(n)]
    rows, want = [], {}
    for k in range(50):
        passage, before, after = own(30), own(33), own(21)
        rows += [(2 * k, "First line.\n" + " ".join(passage) + "\nLast line."), (2 * k + 1, " ".join([*before, *passage, *after]))]
        want |= {2 * k: rows[-2][1], 2 * k + 1: " ".join([*before, *after])}
    got = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), min_words=25).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_a_passage_without_spaces(spark):
    rng = np.random.default_rng(12)
    letters = lambda n: "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA0, n))
    passage = letters(60)
    texts = [letters(33) + passage + letters(20), letters(50) + passage + letters(41)]
    got = {r.doc_id: r for r in substring.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert not got[0].removed and [texts[1][a:b] for a, b in got[1].removed] == [passage]


def test_a_passage_that_repeats_inside_a_text(spark):
    rng = np.random.default_rng(14)
    own = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 8)) for _ in range(n))
    passage, a, b, c = own(70), own(20), own(10), own(30)
    rows = [(1, f"{a} {passage} {b} {passage} {c}"), (2, " ".join(["ha"] * 200)), (None, f"{c} {passage}"), (3, " ".join(["one two"] * 100))]
    got = {r.doc_id: r.text for r in substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == f"{a} {passage} {b} {c}" and got[None] == c
    assert set(got[2].split()) == {"ha"} and 50 <= len(got[2].split()) < 120 and 50 <= len(got[3].split()) < 160


def test_units_of_a_repeated_word_are_few():
    """A text of one word has a unit for each 4 words; the passages around it are found from both sides."""
    words = substring.hashes("a b c d " + "ha " * 10_000 + "x y z", {})
    found = substring.digests(words, 16)
    places = substring.anchors(found, 35)
    few = substring.thinned(found[places], places, 16)
    assert len(places) > 9_000 and len(few) < 2_600 and set(few) <= set(places) and {4, 4 + 10_000 - 16} <= set(few)
    assert max(np.diff(few)) <= 35


def test_whole_lines_go_at_any_length_if_asked(spark):
    texts = [
        "Own first words.\nShare this page now\nSome more of the text\nok", "An other text.\n  - share THIS page, now\nIts own end here\nok", "Share this page now",
        "Before it: share this page now and after", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substring.deduplicate(docs, line_words=3).collect()
    assert {r.doc_id: r.text for r in got} == {**dict(enumerate(texts)), 1: "An other text.\nIts own end here\nok", 2: ""}
    assert [texts[1][a:b] for r in got if r.doc_id == 1 for a, b in r.removed] == ["- share THIS page, now"]
    assert not any(r.removed for r in substring.deduplicate(docs).collect())


@given(st.text(alphabet="a \n", max_size=30), st.lists(st.integers(0, 30), max_size=6))
@settings(max_examples=200, deadline=None)
def test_what_is_left(text, cuts):
    cuts = sorted({c for c in cuts if c <= len(text)})
    runs = [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=False) if not text[a:b].isspace() and not text[a].isspace() and not text[b - 1].isspace()]
    runs = substring.spans(text, [], []) if not runs else [r for k, r in enumerate(runs) if not k or not text[runs[k - 1][1] : r[0]].isspace()]
    kept = [text[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(text)], strict=True)]
    assert "".join(substring.without(text, runs).split()) == "".join("".join(kept).split())


def test_a_long_text_with_many_repeats_is_linear():
    text = " ".join(f"w{k}" for k in range(200_000))
    runs = [(m.start(), m.end()) for k, m in enumerate(re.finditer(r"\w+", text)) if k % 2]
    assert len(substring.without(text, runs).split()) == 100_000


def test_substrings_of_odd_rows(spark, odd, nothing):
    got = substring.deduplicate(odd)
    assert got.columns == [*odd.columns, "_removed"] and got.count() == odd.count()
    assert {r.text for r in got.collect() if r.doc_id == 1} == {None}
    cut = substring.cut(odd)
    assert cut.columns == odd.columns and {r.doc_id for r in cut.collect()} == {r.doc_id for r in odd.collect()}
    twice = [r.text for r in cut.collect() if r.doc_id == 5]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert substring.cut(nothing).count() == 0


def test_decontamination_against_brute_force(spark, sf_dir):
    docs, bench = base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark")
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    text = {r.doc_id: r.text for r in docs.collect()}
    whole = decontaminate.report(docs, bench).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.items_sha256) for r in whole} == {i: decontaminate.brute_force(t, items) for i, t in text.items()} and any(r.n_hit for r in whole)
    parts = decontaminate.report(docs, bench, part_windows=700).collect()
    assert sorted(parts) == sorted(whole)
    for r in whole:
        inside = [w for a, b in r.spans for w in decontaminate.WORD.findall(decontaminate.normalised(text[r.doc_id][a:b]))]
        assert len(inside) == r.n_hit
    gone = {r.doc_id for r in whole if r.contaminated}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == set(text) - gone


def test_decontamination_of_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "ONE"), (None, "x"), (3, "two words")], "item_id long, text string")
    got = decontaminate.report(odd, bench).collect()
    assert len(got) == odd.count()
    assert {(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got if r.doc_id in (4, 9)} == {(1, 1, 1, True)}
    assert {(r.n_words, r.contaminated) for r in got if r.doc_id in (1, 2, 3, 7)} == {(0, False)}
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert decontaminate.clean(odd, bench.limit(0)).count() == odd.count() and decontaminate.clean(nothing, bench).count() == 0


def test_whole_lines_of_the_query(spark, sf_dir):
    """Of equal lines of 25 words or more, by their words, the earliest stays and every later one goes whole; shorter ones stay where nothing longer holds them."""
    texts = sorted((r.doc_id, r.text) for r in base.table(spark, sf_dir, "documents").collect() if r.text)
    got = {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in queries.op10_substring(spark, sf_dir).collect()}
    seen, later, first = set(), 0, 0
    for doc_id, text in texts:
        start = 0
        for line in text.split("\n"):
            words = tuple(w.lower() for w in substring._WORD.findall(line))
            a, b = start + len(line) - len(line.lstrip()), start + len(line.rstrip())
            if len(words) >= 25:
                gone = any(x <= a and b <= y for x, y in got[doc_id][1])
                if words in seen:
                    later += 1
                    assert gone, (doc_id, line)
                else:
                    first += not gone
                    seen.add(words)
            start += len(line) + 1
    assert later > 20 and first > 500
