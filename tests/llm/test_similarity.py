"""N-gram join, line dedup, fingerprints and decontamination against brute force, and on odd tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetlens.llm import ngram_join as join
from fleetlens.llm.codes import rolling_hash
from fleetlens.llm.decontaminate import find_items, without_items
from fleetlens.llm.line_dedup import LineRuns, dedup_lines
from fleetlens.llm.winnow import K, W, fingerprints, likeness, unpacked, winnow
from tests.llm.conftest import LINE


def word_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute_join(rows, n, pct):
    sets = {d: word_set(t, n) for d, t in rows}
    root, links = {d: d for d in sets}, Counter()

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= pct * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d), links[d]) for d, s in sets.items()}


def joined(df, n, pct):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in join.ngram_join(df, n, pct).collect()}


@pytest.mark.parametrize(("n", "pct"), [(4, 85), (5, 80)])
def test_join_brute_force(spark, documents, sample, n, pct):
    assert joined(documents, n, pct) == brute_join(sample, n, pct)


def test_join_near_copies(spark):
    """A group of edited copies with links near the threshold, short texts, and a passage that many share."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(90):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((d, " ".join(words[: rng.choice([120, 120, 60])])))
    shared = " ".join(f"s{i}" for i in range(20))
    rows += [(100 + d, shared + " " + " ".join(f"u{d}_{i}" for i in range(rng.choice([1, 2, 3, 30])))) for d in range(60)]
    rows += [(200 + d, " ".join(rng.choice("pqrs") for _ in range(rng.randrange(1, 9)))) for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df, 4, 85) == brute_join(rows, 4, 85)


def test_join_tiles(spark, monkeypatch):
    """Many small tiles give the same links as one."""
    monkeypatch.setattr(join, "TILE_ROWS", 7)
    monkeypatch.setattr(join, "COARSE_ROWS", 9)
    rows = [(d, " ".join(f"b{i}" if i != d % 40 else f"x{d}" for i in range(60 + d % 3))) for d in range(50)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85) == brute_join(rows, 4, 85)


def level_of(u, pct):
    return int(np.searchsorted(join.size_bounds(pct), len(u), "right")) - 1


@pytest.mark.parametrize("pct", [80, 85])
def test_linked_sets_share_a_key(pct):
    """Pairs at the bound of the overlap, of all sizes: on the level of the smaller set a key is common, and coarse counts let them pass."""
    rng = np.random.default_rng(pct)
    for n in [*range(1, 60), *rng.integers(60, 900, 300).tolist()]:
        for least in (n, -(-n * pct // 100)):  # as large as the smaller set can be, and as small as its partner allows
            both = rng.integers(0, 2**63, least).astype(np.uint64) * np.uint64(2)
            u = np.unique(np.append(both, rng.integers(0, 2**63, n - least).astype(np.uint64)))
            room = max(len(u), len(both) * 100 // pct + len(both) - len(u)) - len(both)
            v = np.unique(np.append(both, rng.integers(0, 2**63, max(0, room)).astype(np.uint64)))
            o = len(np.intersect1d(u, v))
            if 100 * o < pct * (len(u) + len(v) - o):
                continue
            level = min(level_of(u, pct), level_of(v, pct))
            assert max(level_of(u, pct), level_of(v, pct)) <= level + 1
            assert len(np.intersect1d(join.part_keys(u, level, pct), join.part_keys(v, level, pct)))
            rows = [(0, 0, k, len(w), join.coarse_counts(w, level, pct), False) for k, w in enumerate((u, v))]
            assert join._close(rows, pct).num_rows == 1


def test_frequent_ngrams_do_not_tie_sets():
    """Sets that hold some frequent n-grams and are else different hardly share a key, and coarse counts tell them apart: clusters stay small as the table grows."""
    rng, pct = np.random.default_rng(1), 80
    frequent = rng.integers(0, 2**63, 5).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(np.append(frequent, rng.integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2))) for _ in range(200)]
    level = level_of(sets[0], pct)
    _, held = np.unique(np.concatenate([join.part_keys(u, level, pct) for u in sets]), return_counts=True)
    assert held.max() < 0.2 * len(sets)
    pairs = join._close([(0, 0, k, len(u), join.coarse_counts(u, level, pct), False) for k, u in enumerate(sets)], pct)
    assert pairs.num_rows == 0


def test_join_odd_rows(messy, empty):
    rows = join.ngram_join(messy).collect()
    assert len(rows) == messy.count()
    got = {r.doc_id: r for r in rows}
    assert got[6].component_id == got[7].component_id == 6 and got[13].component_id == 6
    assert got[1].n_shingles == got[2].n_shingles == got[3].n_shingles == 0 and got[3].component_id == 3
    assert got[4].n_shingles == 1 and got[None].component_id is None
    assert join.ngram_join(empty).count() == 0


def test_overlaps_dense_and_sparse():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 200, 60).astype(np.uint64)) for _ in range(70)]
    block = np.repeat([0, 1], 35)
    both = join.overlaps(block, sets)
    for i in range(70):
        for j in range(i + 1, 70):
            assert both[i, j] == (len(np.intersect1d(sets[i], sets[j])) if block[i] == block[j] else 0)


def test_line_runs(spark, messy, empty):
    out = {r.doc_id: r for r in dedup_lines(messy).collect()}
    assert len(dedup_lines(messy).columns) == len(messy.columns) + 1  # n_lines gives way, n_dropped is new
    assert (out[8].text, out[8].n_lines, out[8].n_dropped) == ("first", 3, 2)
    assert out[9].text == "second" and out[10].text == f"{LINE}\n"
    assert (out[1].text, out[1].n_lines) == ("", 1) and out[2].n_lines == 1
    assert dedup_lines(empty).count() == 0


def test_line_runs_compact(spark):
    runs = LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(k, f"{LINE}\nown line number {k} of this document")], "doc_id long, text string"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert [(r.n_docs, r.last_doc) for r in runs.repeated().collect()] == [(5, 4)]


def test_winnow_guarantee():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 101, 3000).astype(np.uint32)
    hashes, places = winnow(text)
    assert np.diff(places).max() <= W and (np.diff(places) > 0).all()
    other = np.concatenate([rng.integers(97, 101, 400).astype(np.uint32), text[1000 : 1000 + W + K - 1]])
    assert likeness(np.unique(hashes), np.unique(winnow(other)[0])) > 0
    # Of equal hashes in a window the rightmost is chosen.
    same = np.full(200, 97, np.uint32)
    assert winnow(same)[1].tolist() == list(range(W - 1, 200 - K + 1))


def test_fingerprints(spark, documents, sample):
    got = {r.doc_id: r for r in fingerprints(documents).collect()}
    for k, (d, text) in enumerate(sample):
        after, n = sample[(k + 1) % len(sample)][1], len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        assert (got[d].n_chars, got[d].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        hashes, places = unpacked(got[d].fingerprint)
        assert len(hashes) == got[d].n_prints and places == winnow(np.frombuffer(text.encode("utf-32-le"), np.uint32))[1].tolist()


def plain_prints(text):
    """(hash, place) of the chosen grams, one gram and one window at a time."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(points):
        return []
    k = min(K, len(points))
    grams = [int(rolling_hash(points[i : i + k].copy(), k)[0]) >> 32 for i in range(len(points) - k + 1)]
    chosen = {}
    for at in range(max(1, len(grams) - W + 1)):
        window = range(at, min(at + W, len(grams)))
        best = max((i for i in window if grams[i] == min(grams[j] for j in window)))
        chosen[best] = grams[best]
    return sorted((i, h) for i, h in chosen.items())


def test_fingerprints_brute_force(spark, documents, sample):
    """Hashes, places and both likenesses of some texts, from plain loops."""
    got = {r.doc_id: r for r in fingerprints(documents).collect()}
    alike = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
    short = [k for k, (_, t) in enumerate(sample) if len(t or "") < 1500][:20]
    for k in short:
        d, text = sample[k]
        after, n = sample[(k + 1) % len(sample)][1] or "", len(text or "")
        text = text or ""
        own, edited, following = plain_prints(text), plain_prints(text[: n - n // 2] + after[: n // 2]), plain_prints(after[:4000]) if len(after) <= 4000 else None
        assert list(zip(*unpacked(got[d].fingerprint)[::-1])) == own and list(zip(*unpacked(got[d].edited_fingerprint)[::-1])) == edited
        sets = [{h for _, h in found} for found in (own, edited)]
        assert got[d].near_edited == pytest.approx(alike(*sets))
        if following is not None:
            assert got[d].near_next == pytest.approx(alike(sets[0], {h for _, h in following}))


def test_fingerprints_in_ranges(spark, documents, monkeypatch):
    whole = {r.doc_id: r for r in fingerprints(documents).collect()}
    monkeypatch.setattr("fleetlens.llm.winnow.BUCKET_ROWS", 17)
    assert {r.doc_id: r for r in fingerprints(documents).collect()} == whole


def test_fingerprints_odd_rows(messy, empty):
    rows = fingerprints(messy).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == messy.count() and got[1].fingerprint == got[2].fingerprint == "" and got[1].near_next == 1.0
    assert got[6].fingerprint == got[7].fingerprint == got[None].fingerprint
    assert fingerprints(empty).count() == 0
    one = fingerprints(messy.filter("doc_id = 6")).first()
    assert one.near_next == 1.0


ITEM = "A train leaves Paris at 9 with 120 passengers and Anna counts 45 km before the next stop in Lyon where 30 people leave"


def test_items(spark):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "two words"), (4, ITEM)], "item_id long, text string")
    other = ITEM.replace("Paris", "Rome").replace("120", "3,500").replace("Anna", "Peter").replace("45", "7.5").replace("Lyon", "Milan")
    broken = "x " + ITEM.replace("120", "9").replace("30", "17")
    twice = "What was 12 of 12 if the man had 12 apples and 12 pears in his old basket today"
    items = items.union(spark.createDataFrame([(5, twice)], items.schema))
    docs = [
        (1, "Before. " + ITEM + " after"), (2, "Before. " + other + " after"), (3, "nothing here of the kind at all and nothing more to see"), (4, None), (5, ""), (6, broken),
        (7, twice.replace("12", "88")), (8, twice.replace("12", "88", 1)), (9, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"),
    ]
    found = find_items(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    pairs = {(r.doc_id, r.item_id): r.changed for r in found}
    assert {k for k in pairs if k[1] == 1} == {(1, 1), (2, 1), (6, 1)} and pairs[1, 1] == 0 and pairs[2, 1] >= 3
    assert (1, 4) in pairs and (7, 5) in pairs and (8, 5) in pairs and not any(d in (3, 4, 5, 9) for d, _ in pairs)


def test_items_by_most_places(spark):
    """Equal values of an item may vary apart; a value that changes in one place costs the windows with that place alone."""
    apart = "Tom has got 3 apples in a big bowl and his sister has got 3 pears in her bag so how many fruits are there"
    rare = " ".join(f"w{chr(97 + i)} 4 v{chr(97 + i)}" for i in range(12))
    docs = [
        (1, "so " + apart.replace("3 apples", "5 apples").replace("3 pears", "7 pears")), (2, rare.replace("wc 4", "wc 9")),
        # Half of the places have values of their own: too few windows agree.
        (3, " ".join(f"w{chr(97 + i)} {i * 11} v{chr(97 + i)}" if i % 2 else f"w{chr(97 + i)} 8 v{chr(97 + i)}" for i in range(12))),
    ]
    items = spark.createDataFrame([(1, apart), (2, rare)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in find_items(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert set(found) == {(1, 1), (2, 2)} and found[1, 1].changed == 2 and found[2, 2].changed == 0 and 20 < found[2, 2].words < 36


def test_items_by_chain(spark):
    """Two windows far apart are no copy; a copy with a word put in between is."""
    words = [f"w{chr(97 + i)}" for i in range(26)] + [f"v{chr(97 + i)}" for i in range(26)]
    gap = " ".join(f"g{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    far = " ".join([*words[:8], gap, *words[30:38]])
    near = " ".join([*words[:10], "extra", *words[10:20]])
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, far), (2, near), (3, " ".join(words))], "doc_id long, text string")
    assert {r.doc_id: r.words for r in find_items(docs, items).collect()} == {2: 20, 3: 52}


def test_items_word_for_word(spark):
    """Copies in another case, of numbers, of names, and whole copies are found by their plain words."""
    names = "In the list Anna Peter Maria Oscar Felix Laura Clara Simon David Julia Martin Sophie Paul Emma"
    sums = "3 + 4 = 7 and 12 - 5 = 7 and 6 * 8 = 48 and 81 / 9 = 9 and 15 + 16 = 31"
    items = [(1, ITEM), (2, names), (3, sums)]
    docs = [(1, "x y " + ITEM.upper()), (2, "x y " + ITEM.lower() + " z"), (3, "so " + names.lower()), (4, "so " + names + " z"), (5, "so " + sums), (6, sums.replace("4", "5").replace("12", "19").replace("81", "80").replace("15", "44"))]
    found = find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)} and all(r.changed == 0 and r.share == 1 for r in found)


def test_items_odd_rows(spark, messy, empty):
    items = spark.createDataFrame([(None, "the quick brown fox jumps over the lazy dog near the river bank")], "item_id long, text string")
    kept = without_items(messy, items)
    assert kept.columns == messy.columns and sorted(r.doc_id for r in kept.filter("doc_id > 5").collect()) == [8, 9, 10, 11, 12]
    assert without_items(empty, items).count() == 0 and without_items(messy, items.limit(0)).count() == messy.count()


def test_join_of_large_sets(spark):
    """Exactly 85 % of two sets of over 90 000 shingles: beyond what single precision counts."""
    common = " ".join(f"c{i}" for i in range(90_732))
    rows = [(k, common + " " + " ".join(f"{'xy'[k]}{i}" for i in range(8005 + k))) for k in range(2)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85) == {0: (98_734, 0, 1), 1: (98_735, 0, 1)}


def test_lines_of_repeated_ids(spark):
    """Rows that repeat a doc_id are one document."""
    rows = [(1, LINE), (1, LINE), (2, LINE), (None, "n" * 30), (None, "n" * 30), (3, "n" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in dedup_lines(docs).collect())
    more = docs.union(spark.createDataFrame([(4, LINE), (5, "n" * 30)], docs.schema))
    assert sorted((r.doc_id or 0, r.n_dropped) for r in dedup_lines(more).collect()) == [(0, 1), (0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 0), (5, 0)]
