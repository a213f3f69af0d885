"""The training-data operators against brute force on small tables that hold nulls, empty and long texts,
ties, repeated rows and extra columns; each also on an empty table."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repolens.llm import bitplanes, exact_dedup, golay, language, mixing, near_dedup, ogg, packing, quality, simhash, substring_dedup, suffix, tokens, toxicity
from repolens.llm.common import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, digest string, owner int"


def table(spark, rows):
    """(id, text) rows with languages, sources and columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, ["en", "fr", None][k % 3], f"src{k % 4}", None, "x", "y", 1) for k, (i, t) in enumerate(rows)], SCHEMA)


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}x{rng.randrange(9)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [words(rng, rng.randrange(5, 120)) for _ in range(30)]
    shared = words(rng, 40)
    out = list(enumerate(base))
    out += [(40, base[3]), (41, base[3].replace(" ", " \t\n ", 1)), (42, base[5] + " tail"), (43, " ".join(base[7].split()[1:])), (44, words(rng, 9) + " " + shared), (45, shared + words(rng, 9))]
    out += [(50, None), (51, ""), (52, " "), (None, "no id " + shared), (None, None), (40, base[3]), (40, "other text of the same id"), (60, words(rng, 30_000)), (61, "é'ß don't 日本 ×÷ l'été\x1c"), (62, "a" * 400), (63, "a" * 300), (64, "end <|endoftext|> of <|endoftext|>")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_bytes(t):
    return (t or "").encode()


def test_ogg_round_trip(spark, docs, rows):
    got = ogg.media_features(ogg.text_to_media(docs)).collect()
    want = sorted((len(b), hashlib.sha256(b.ljust(max(192, -(-len(b) // 192) * 192))).hexdigest()) for b in (as_bytes(t) for _, t in rows))
    assert sorted((r["n_bytes"], r["payload_sha256"]) for r in got) == want
    assert all(r["bad_pages"] == 0 for r in got)
    assert ogg.media_features(ogg.text_to_media(empty(spark))).count() == 0


def test_ogg_damage_is_found():
    payload = bytes(range(256)) * 900
    media = bytearray(ogg.encode(payload))
    assert ogg.decode(bytes(media))[0] == payload
    media[100_000] ^= 1
    out, streams, wrong = ogg.decode(bytes(media))
    assert out != payload and wrong and sum(s.bad_pages for s in streams.values()) == 1
    late = ogg.demultiplex(b"junk" + ogg.encode(payload))[ogg.SAMPLES_SERIAL]
    assert late.duration == len(payload) / 8000 and late.ended and b"".join(late.packets[1:]) == payload


def slow_checksum(data):
    r = 0
    for b in data:
        r ^= b << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


def test_ogg_checksum():
    for data in (b"", b"OggS", bytes(range(256))):
        assert ogg.checksum(data) == slow_checksum(data)


def test_tokens_equal_the_library():
    t = tokens.WordTokenizer(tokens.default_path())
    rng = random.Random(2)
    alphabet = " \n\t'aslredvtm1!.é ß’"
    texts = [None, "", "it's 'll x'd ''s", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>\nc", "é<|endoftext"] + ["".join(rng.choice(alphabet[: rng.choice((6, 14, 19))]) for _ in range(rng.randrange(40))) for _ in range(2000)]
    ids, at = t.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library_ids(texts)


def test_tokens_with_a_small_table_and_equal_hashes(monkeypatch):
    """Pre-tokens are forgotten and learned again, and words of one hash are told apart."""
    rng = random.Random(5)
    texts = [words(rng, 300, 2000) for _ in range(60)]
    monkeypatch.setattr(tokens, "TABLE_WORDS", 500)
    for one_hash in (False, True):
        if one_hash:
            monkeypatch.setattr(tokens, "word_hashes", lambda a: np.ones(len(a), np.uint64))
        t = tokens.WordTokenizer(tokens.default_path())
        for low in range(0, 60, 7):
            ids, at = t.encode(pa.array(texts[low : low + 7], pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library_ids(texts[low : low + 7])
        assert len(t.words) < 5000


def library_ids(texts):
    """Plain calls of the library with its file as it is."""
    library = Tokenizer.from_file(tokens.default_path())
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def plain_ids(rows, end):
    return [(i, x + [end]) for (i, _), x in zip(rows, library_ids([t for _, t in rows]), strict=True)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(spark, docs, rows, kind):
    path = scratch_path(spark, "test-planes")
    bitplanes.write_ids(docs, path, kind=kind)
    got = bitplanes.read_documents(spark, path).collect()
    want = plain_ids(rows, 0)
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((len(x), crc(x)) for _, x in want)
    spans = sorted((r["start"], r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got)
    assert [s for s, _, _ in spans] == np.cumsum([0] + [n for _, n, _ in spans])[:-1].tolist()
    assert [i for _, _, i in spans] == sorted(-1 if i is None else i for i, _ in rows)


def test_planes_of_nothing_and_a_broken_file(spark):
    path = scratch_path(spark, "test-empty")
    bitplanes.write_ids(empty(spark), path)
    assert bitplanes.read_documents(spark, path).count() == 0
    writer = bitplanes.Writer(0)
    data = b"".join(r + b"\n" for r in [*writer.add(np.arange(200_000, dtype=np.uint32), [7], np.array([200_000])), *writer.close()])
    assert bitplanes.Reader(data).ids(65_530, 131_080).tolist() == list(range(65_530, 131_080))
    with pytest.raises(ValueError):
        bitplanes.Reader(data[:-1])


def test_packing_places_every_piece_once(spark, docs, rows):
    pieces = packing.document_pieces(docs).collect()
    want = []
    for i, ids in plain_ids(rows, 2):
        n = -(-len(ids) // 1024)
        cuts = [0] + [len(ids) - 1024 * k for k in range(n - 1, -1, -1)]
        want += [(-1 if i is None else i, k, cuts[k], cuts[k + 1] - cuts[k], crc(ids[cuts[k] : cuts[k + 1]])) for k in range(n)]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in pieces) == sorted(want)
    placed = packing.pack(packing.document_pieces(docs)).collect()
    assert len(placed) == len(want)
    by = {}
    for r in placed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for seq in by.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.document_pieces(empty(spark))).count() == 0


def bins_of(plan):
    fill = {}
    for size, lo, hi, each, base, offset in plan.runs:
        for rank in range(lo, hi):
            fill.setdefault(base + (rank - lo) // each, []).append((offset + (rank - lo) % each * size, size))
    return fill


def fewest(sizes, cap):
    """Fewest bins, by trying every placement."""
    best = [len(sizes)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values():
            go(k + 1, [r - sizes[k] * (j == i) for j, r in enumerate(rooms)])
        go(k + 1, [*rooms, cap - sizes[k]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_bin():
    rng = random.Random(3)
    for _ in range(250):
        cap = rng.choice((10, 20, 30))
        counts = {rng.randint(1, cap): rng.randint(1, 2) for _ in range(rng.randint(1, 5))}
        plan = packing.Plan()
        classes = packing._Classes(counts)
        packing.reduce_instance(classes, plan, cap)
        sizes = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True)
        left = sorted((s for s, n in classes.left.items() for _ in range(n)), reverse=True)
        assert plan.bins + fewest(left, cap) == fewest(sizes, cap)
        full = packing.plan_packing(counts, cap)
        fill = bins_of(full)
        assert sorted((s for b in fill.values() for _, s in b), reverse=True) == sizes and len(fill) == full.bins
        for b in fill.values():
            at = 0
            for offset, s in sorted(b):
                assert offset == at
                at += s
            assert at <= cap


def test_golay_lists_cover_two_errors():
    assert len({golay._remainder(sum(1 << b for b in x)) for x in [(), *[(i,) for i in range(23)]]}) == 24
    rng = np.random.default_rng(1)
    word = rng.integers(0, 1 << 23, 300)
    near = golay.nearby(word)
    assert all(bin(w ^ ((int(c) << 11) | golay._remainder(int(c) << 11))).count("1") <= 4 for w, row in zip(word.tolist(), near.tolist(), strict=True) for c in row if c >= 0)
    for _ in range(40):
        a, b = rng.integers(0, 23, 2)
        other = golay.nearby(word ^ (1 << a) ^ (1 << b))
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(near, other, strict=True))


def test_golay_links_lose_nothing():
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = list({x for b in base for x in [b] + [b ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(1, 7))) for _ in range(30)]})
    words_ = np.array(prints, np.uint64).view(np.int64)
    row, key = simhash.golay_keys(simhash.segments_of_64([words_]))
    order = np.lexsort((words_[row], key))
    a, b = simhash.links_in_runs(key[order], words_[row][order], [words_[row][order]], 4)
    parent = {x: x for x in words_.tolist()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        parent[find(x)] = find(y)
    u = words_.view(np.uint64)
    apart = np.bitwise_count(u[:, None] ^ u[None, :])
    for i, j in zip(*np.nonzero(apart <= 4), strict=True):
        assert find(int(words_[i])) == find(int(words_[j]))


def slow_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", as_bytes(t).lower())
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_components(spark, docs, rows):
    got = simhash.fingerprint_components(docs).collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{p:016x}" for p in prints)
    label = list(range(len(prints)))
    for _ in prints:
        label = [min(label[j] for j in range(len(prints)) if bin(prints[i] ^ prints[j]).count("1") <= 4) for i in range(len(prints))]
    name = {k: min((rows[i][0] for i in range(len(rows)) if label[i] == k and rows[i][0] is not None), default=-1) for k in set(label)}
    want = sorted((-1 if i is None else i, f"{p:016x}", name[k]) for (i, _), p, k in zip(rows, prints, label, strict=True))
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in got) == want
    assert simhash.fingerprint_components(empty(spark)).count() == 0


def test_exact_groups(spark, docs, rows):
    got = exact_dedup.exact_groups(docs).collect()
    body = [re.sub(rb"[\x20\x09-\x0D]+", b" ", as_bytes(t)) for _, t in rows]
    want = []
    for (i, _), b in zip(rows, body, strict=True):
        ids = [j for (j, _), c in zip(rows, body, strict=True) if c == b]
        low = min((j for j in ids if j is not None), default=-1)
        want.append((-1 if i is None else i, low, len(ids), hashlib.sha256(b).hexdigest()))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["keep_id"] is None else r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == sorted(want)
    assert sum(r["kept"] for r in got) == len(set(body))
    assert sorted(hashlib.sha256(re.sub(rb"[\x20\x09-\x0D]+", b" ", as_bytes(r["text"]))).hexdigest() for r in exact_dedup.drop_exact_copies(docs).collect()) == sorted(hashlib.sha256(b).hexdigest() for b in set(body))
    assert exact_dedup.drop_exact_copies(docs).columns == docs.columns
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_trie_spills_by_subtree():
    trie, rng, want = exact_dedup.PatriciaTrie(), random.Random(1), {}
    parts = []
    for k in range(600):
        key = bytes(rng.choice(b"abc") for _ in range(rng.randrange(12)))
        trie.insert(key, k)
        want.setdefault(key, [k, 0])[1] += 1
        if trie.n_bytes > 6000:
            parts += trie.take(trie.largest())
    parts += trie.take()
    merged = exact_dedup.PatriciaTrie()
    for key, owner, n in parts:
        merged.insert(key, owner, n)
    assert {k: [o, n] for k, o, n in merged.take()} == want


def slow_removed(rows):
    first = {}
    for i, t in rows:
        b = as_bytes(t)
        for p in range(len(b) - 49):
            g = b[p : p + 50]
            first[g] = min(first.get(g, 1 << 62), 1 << 62 if i is None else i)
    out = []
    for i, t in rows:
        b = as_bytes(t)
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (1 << 62 if i is None else i):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((-1 if i is None else i, len(b), sum(gone), sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_are_removed_exactly(spark, docs, rows):
    got = substring_dedup.remove_repeats(docs).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == slow_removed(rows)
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("split", [2, 40, substring_dedup.SPLIT])
def test_one_anchor_in_many_contexts(spark, split):
    """A line of many texts, with sides that some of them share: dealt by halves or not, the result is the same."""
    rng = random.Random(8)
    sides = ["".join(rng.choice("abcdefgh ") for _ in range(45)) for _ in range(14)]
    line = "= the line that all texts have ="
    rows = []
    for i in range(150):
        left, right = (rng.choice(sides) if rng.random() < 0.7 else "".join(rng.choice("ijklmnop ") for _ in range(45)) for _ in range(2))
        rows.append((rng.randrange(120), left[rng.randrange(30) :] + line + right[: rng.randrange(16, 45)]))
    got = substring_dedup.remove_repeats(table(spark, rows).repartition(3), split).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == slow_removed(rows)


def test_maximal_repeats_against_all_substrings():
    rng = random.Random(6)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(3)]
        places = {}
        for k, s in enumerate(strings):
            for i in range(len(s)):
                for j in range(i + 2, len(s) + 1):
                    places.setdefault(s[i:j], set()).add((k, i))
        want = {}
        for text, where in places.items():
            left = {strings[k][i - 1] if i else ("start", k) for k, i in where}
            right = {strings[k][i + len(text)] if i + len(text) < len(strings[k]) else ("end", k) for k, i in where}
            if len(where) > 1 and len(left) > 1 and len(right) > 1:
                want[text] = where
        array = suffix.SuffixArray(strings)
        got = {}
        for length, at in array.maximal_repeats(2):
            spots = {(int(array.owner[p]), int(p - array.begin[array.owner[p]])) for p in at}
            k, i = next(iter(spots))
            got[strings[k][i : i + length]] = spots
        assert got == want


def test_near_copies_against_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for k in range(12):
        base = words(rng, 150, 5000).split()
        rows.append((k * 10, " ".join(base)))
        for c in range(4):
            copy = list(base)
            for p in rng.sample(range(150), rng.choice((1, 2, 3, 12))):
                copy[p] = f"new{k}{c}{p}"
            rows.append((k * 10 + c + 1, " ".join(copy)))
    rows += [(500, "one two"), (501, "One  two"), (502, None), (503, ""), (None, "one two")]
    sets = [set(simhash.shingle_hashes(as_bytes(t), 5).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    alike = [[j for j in range(len(rows)) if (len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))] for i in range(len(rows))]
    for _ in rows:
        label = [min(label[j] for j in alike[i]) for i in range(len(rows))]
    want = sorted(min((rows[i][0] for i in range(len(rows)) if label[i] == k and rows[i][0] is not None), default=-1) for k in set(label))
    frame = table(spark, rows)
    kept = near_dedup.drop_near_copies(frame)
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == want
    assert kept.columns == frame.columns
    assert near_dedup.drop_near_copies(empty(spark)).count() == 0


def test_cut_extended_and_filled_copies_against_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for k in range(60):
        base = words(rng, 200, 50_000).split()
        more = words(rng, 30, 50_000).split()
        at = rng.randrange(200)
        rows += [(4 * k, base), (4 * k + 1, base[:172]), (4 * k + 2, base + more), (4 * k + 3, base[:at] + more + base[at:])]
    rows = [(i, " ".join(t)) for i, t in rows]
    frame = table(spark, rows)
    sets = [set(simhash.shingle_hashes(as_bytes(t), 5).tolist()) for _, t in rows]
    nodes = [i for i, _ in rows]
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(alike) >= 180
    want = simhash.forest(*np.array([[nodes[i], nodes[j]] for i, j in alike], np.int64).T)
    for block in (20, 2000):
        links = near_dedup.near_links(frame.select(F.col("doc_id").alias("node"), "text"), block).collect()
        got = simhash.forest(*np.array([tuple(r) for r in links], np.int64).T)
        assert sorted(zip(*got)) == sorted(zip(*want))


def test_blocks_find_what_one_task_finds(spark, monkeypatch):
    rng = random.Random(5)
    base = words(rng, 120, 5000).split()
    rows = []
    for k in range(25):
        copy = list(base)
        copy[rng.randrange(120)] = f"z{k}"
        rows.append((k, " ".join(copy)))
    frame = table(spark, rows).select(F.col("doc_id").alias("node"), "text")
    for block, block_words in ((4, 1_500_000), (2000, 500), (2000, 1_500_000)):
        monkeypatch.setattr(near_dedup, "BLOCK_WORDS", block_words)
        links = [tuple(r) for r in near_dedup.near_links(frame, block).collect()]
        a, b = simhash.forest(*np.array(links, np.int64).T)
        assert len(a) == 24


def test_marks_never_say_too_much():
    """Sets of any sizes differ at least as much as their marks say, and unlike ones are told apart."""
    rng = np.random.default_rng(3)
    for n, m, both in [(0, 5, 0), (300, 310, 290), (1900, 2100, 1800), (2100, 2300, 0), (9000, 8000, 7900), (40_000, 45_000, 0), (70_000, 70_000, 69_000), (1500, 90_000, 1000)]:
        pool = rng.integers(0, 1 << 63, n + m - both).astype(np.uint64)
        x, y = np.sort(pool[:n]), np.sort(pool[n - both :])
        least = near_dedup.apart(near_dedup.mark_of(x), near_dedup.mark_of(y))
        assert least <= n + m - 2 * both
        assert least == near_dedup.apart(near_dedup.mark_of(y), near_dedup.mark_of(x))
        if not both and n > 100:
            assert not near_dedup.enough((n + m - least) // 2, n, m)
    same = rng.integers(0, 1 << 52, 30_000).astype(np.uint64) * np.uint64(1024)  # all in one of few bins
    assert near_dedup.apart(near_dedup.mark_of(same), near_dedup.mark_of(same[1:])) <= 1


def test_budgets_fill_siblings_before_ancestors():
    tokens_ = {("d", "en", "a"): 10, ("d", "en", "b"): 100, ("d", "fr", "c"): 100, ("e", "en", "d"): 1000}
    got = mixing.budgets(tokens_, 400, {}, 1)
    assert got == {("d", "en", "a"): 10, ("d", "en", "b"): 90, ("d", "fr", "c"): 100, ("e", "en", "d"): 200}
    assert sum(mixing.budgets(tokens_, 2000, {}, 1).values()) == 1210
    assert mixing.split(7, [1, 1, 1], [9, 9, 9]) == [3, 2, 2]
    assert mixing.budgets({}, 5, {}, 1) == {}


UNEVEN = {("domain0",): 5.0, ("domain1",): 0.5, ("domain2",): 0.0, ("domain3", "en"): 3.0, ("domain0", "en", "src1"): 0.0}


@pytest.mark.parametrize(("fraction", "epochs", "weights"), [(0.4, 1, {}), (1.3, 3, {}), (0.0, 1, {}), (1.0, 1, {}), (0.3, 1, UNEVEN), (0.9, 2, UNEVEN)])
def test_mixture_takes_each_leafs_token_prefix(spark, docs, fraction, epochs, weights):
    counts = mixing.token_counts(docs).cache()
    data = counts.toPandas()
    leaves = {tuple(k): int(v) for k, v in data.groupby(list(mixing.LEVELS)).n_tokens.sum().items()}
    want = mixing.budgets(leaves, int(fraction * sum(leaves.values())), weights, epochs)
    got = mixing.mixture(docs, fraction, weights, epochs).toPandas()
    assert len(got) == len(data)
    for leaf, part in got.groupby(list(mixing.LEVELS)):
        assert part.tokens_taken.sum() == want[leaf]
        split = part[(part.tokens_taken != part.copies * part.n_tokens)]
        assert len(split) <= 1 and (split.tokens_taken - split.copies * split.n_tokens < split.n_tokens).all()
        # in the order of the last epoch, what is taken whole comes first
        whole = want[leaf] // leaves[leaf] if leaves[leaf] else 0
        rest = counts.where((F.col("domain") == leaf[0]) & (F.col("lang") == leaf[1]) & (F.col("source") == leaf[2])).select("n_tokens", mixing.order_in(F.lit(int(whole)), F.col("base"), mixing.SEED).alias("place")).toPandas()
        left, taken = want[leaf] - whole * leaves[leaf], []
        for n in rest.sort_values("place").n_tokens:
            taken.append(whole * n + min(n, left))
            left -= min(n, left)
        assert sorted(taken) == sorted(part.tokens_taken)
    chosen = mixing.select_mixture(docs, fraction, weights, epochs)
    crossed = int((got.tokens_taken > got.copies * got.n_tokens).sum())
    assert got.copies.sum() <= chosen.count() <= got.copies.sum() + crossed + int((got.n_tokens == 0).sum()) and chosen.columns == docs.columns
    assert mixing.mixture(empty(spark), 0.5).count() == 0 and mixing.select_mixture(empty(spark), 0.5).count() == 0


def test_nothing_of_weight_zero_is_drawn():
    tokens_ = {("a", "en", "x"): 10, ("a", "en", "y"): 50, ("a", "fr", "z"): 30, ("b", "en", "x"): 100}
    assert mixing.budgets(tokens_, 60, {("a", "en", "x"): 0.0, ("b",): 0.0}, 1) == {("a", "en", "x"): 0, ("a", "en", "y"): 30, ("a", "fr", "z"): 30, ("b", "en", "x"): 0}
    assert sum(mixing.budgets(tokens_, 500, {("a",): 0.0}, 1).values()) == 100
    assert mixing.budgets(tokens_, 80, {("a",): 3.0}, 1) == {("a", "en", "x"): 10, ("a", "en", "y"): 20, ("a", "fr", "z"): 30, ("b", "en", "x"): 20}
    with pytest.raises(ValueError):
        mixing.budgets(tokens_, 5, {("a",): -1.0}, 1)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_learns_and_orders(spark):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(w + ("!!" if bad else "") for w in words(rng, 30).split())))
        marks.append((i, 0 if bad else 1, int(i % 4 == 1)))
    rows += [(900, None), (901, ""), (None, "some words"), (5, rows[5][1])]
    got = quality.quality_grades(table(spark, rows), labels(spark, marks + [(None, 1, 0), (3, None, None)])).toPandas()
    assert len(got) == len(rows) and got.expected_grade.between(0, 2).all()
    held = got[got.held_out & (got.doc_id < 400)]
    assert (held.keep == (held.doc_id % 4 != 0)).mean() > 0.95
    docs_ = table(spark, rows)
    kept = quality.filter_quality(docs_, labels(spark, marks))
    assert kept.columns == docs_.columns and 250 < kept.count() < 350
    assert quality.quality_grades(table(spark, rows[:5]), labels(spark, [])).where("keep").count() == 5
    assert quality.quality_grades(empty(spark), labels(spark, [])).count() == 0


def test_toxicity_learns_terms_and_catches_misspellings(spark):
    rng = random.Random(10)
    rows, marks = [], []
    for i in range(500):
        text = words(rng, 40)
        toxic = i % 5 == 1
        if toxic:
            text = text.replace(" ", f" you {rng.choice(['grumble', 'snarkle', 'blighter'])} ", 2)
        rows.append((i, text))
        marks.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (902, words(rng, 20) + " you gurmble " + words(rng, 5)), (903, words(rng, 20)), (None, "x")]
    got = toxicity.toxicity(table(spark, rows), labels(spark, marks)).toPandas()
    assert got.score.between(0, 1).all() and len(got) == len(rows)
    known = got[got.held_out & (got.doc_id < 500)]
    assert (known.predicted == (known.doc_id % 5 == 1)).mean() > 0.97
    by = got.set_index("doc_id").score
    assert by[902] > by[903]
    assert toxicity.toxicity(empty(spark), labels(spark, [])).count() == 0


def errors(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_edit_distance():
    rng = random.Random(5)
    for _ in range(1500):
        terms = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 11))) for _ in range(4)]
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        near = [(errors(t, word), t) for t in terms if errors(t, word) <= toxicity.allowed(len(t))]
        assert toxicity.Trie(terms).near(word) == ((min(near)[1], min(near)[0]) if near else None)


def test_quotation_and_abuse_are_told_apart():
    known = toxicity._Known(toxicity.Lexicon(["idiot"], []))
    (quoted,) = toxicity.hits('the word "idiot" is old', known)
    (abuse,) = toxicity.hits("you are an idoit and more", known)
    assert quoted[3] and not quoted[4] and abuse[4] and not abuse[3] and abuse[1] == 3


def test_language_profiles(spark):
    rng = random.Random(2)
    parts = {"aa": ["the", "and", "thing", "other"], "bb": ["le", "être", "ça", "eau"]}
    rows = [(i, " ".join(rng.choice(parts[["aa", "bb"][i % 2]]) for _ in range(20)), ["aa", "bb"][i % 2]) for i in range(120)]
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "the thing", None), (None, "ça être", "bb"), (3, rows[3][1], "bb")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.learn(frame)
    got = language.predict_language(frame, profiles).toPandas()
    by = got.dropna(subset="doc_id").drop_duplicates("doc_id").set_index("doc_id")
    assert all(by.lang_pred[i] == ["aa", "bb"][i % 2] for i in range(120))
    assert by.lang_pred[900] == by.lang_pred[901] == "und" and by.lang_pred[902] == "aa"
    assert got.score.between(0, 1).all() and len(got) == len(rows)
    nothing = language.predict_language(frame, language.learn(frame.limit(0)))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_prototypes_are_bundles_of_bound_letters():
    letters = language.letter_vectors()
    a, b, c = 1, 2, 3
    gram = (a * language.SYMBOLS + b) * language.SYMBOLS + c
    assert (language.gram_vectors(np.array([gram]))[0] == np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]).all()
