"""Each operator against a brute-force version on rows with nulls, odd texts, ties, copies and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from conftest_llm import frame, prose
from pyspark.sql import functions as F

from txnlens.llm import (
    exact_stream, guess_cost, harmonic_pack, imatch, license_bands, line_join, quality_trees, simhash_blocks, stream_bpe, suffix_merge)

P = pytest.importorskip("public_tokenizers")
WORD_FILE, BYTE_FILE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def fold(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


# 1 licences

def test_license_templates_are_found(spark, odd, empty):
    rng = random.Random(1)
    texts = [f"{prose(rng, rng.randrange(0, 90))} {t} {prose(rng, rng.randrange(0, 90))}" for _, t in license_bands.TEMPLATES]
    found = license_bands.license_matches(frame(spark, list(enumerate(texts)))).collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, set()).add((r.license, r.containment))
    for i, (licence, _) in enumerate(license_bands.TEMPLATES):
        assert (licence, 1.0) in by_doc[i]
    assert rows_of(license_bands.license_matches(odd), "doc_id", "license", "containment") == [(21, "MIT", 1.0)]
    assert license_bands.license_matches(empty).count() == 0


def test_license_containment_bound(spark):
    _, text = license_bands.TEMPLATES[2]
    words = text.split()
    four_fifths = license_bands.license_matches(frame(spark, [(1, " ".join(words[:40])), (2, " ".join(words[:25]))])).collect()
    assert [r.doc_id for r in four_fifths] == [1] and four_fifths[0].containment >= 0.8


def test_guard_words_cover_every_sufficient_part():
    for _, text in license_bands.TEMPLATES:
        shingles = [s.split() for s in license_bands.shingles_of(text)]
        own = set(license_bands.guards(text))
        assert sum(not own & set(s) for s in shingles) < 0.8 * len(shingles)


# 2 quality

def test_trees_learn_and_match_their_arrays():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(float)
    trees = quality_trees.fit_trees(x[:1500], y[:1500], trees=40, depth=4)
    assert ((trees.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    slow = []
    for row in x[1500:1550]:
        raw = trees.base
        for f, c, v in zip(trees.feature, trees.cut, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            raw += v[node - len(f)]
        slow.append(1 / (1 + np.exp(-raw)))
    assert np.allclose(trees.score(x[1500:1550]), slow)


def test_quality_ignores_held_out_labels(spark, odd, empty):
    def labels(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    rng = random.Random(2)
    rows = [(i, prose(rng, 40) if i % 2 else "!!! ### " * 40) for i in range(300)]
    docs = frame(spark, rows)
    right = [(i, i % 2, 0) for i in range(300)]
    out = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    wrong = [(i, 1 - q if i in set(out) else q, t) for i, q, t in right]
    a = quality_trees.fit(docs, labels(right + [(None, 1, 0), (3, None, 0), (5, 1, 1)]))
    b = quality_trees.fit(docs, labels(wrong))
    assert np.array_equal(a.value, b.value) and np.array_equal(a.cut, b.cut)
    got = {r.doc_id: r.score for r in quality_trees.scores(docs, a).collect()}
    assert all((got[i] >= 0.3) == (i % 2 == 1) for i in out)
    kept = quality_trees.passing(docs, labels(right))
    assert kept.columns == docs.columns and kept.where("doc_id % 2 = 0").count() == 0 and kept.count() == 150
    # Rows that repeat a learned id don't add to what is learned from.
    seen = quality_trees.fit(docs.unionByName(docs.where("doc_id < 50")), labels(right))
    assert np.array_equal(seen.value, a.value)
    none = quality_trees.fit(odd, labels([]))
    assert {r.score for r in quality_trees.scores(odd, none).collect()} == {0.5}
    assert quality_trees.scores(odd, a).count() == odd.count() and quality_trees.scores(empty, a).count() == 0
    assert quality_trees.fit(docs, labels([(i, 1, 0) for i in range(300)])).score(np.zeros((1, 34)))[0] > 0.9


# 3 exact copies

@pytest.mark.parametrize("weak", [False, True])
def test_copies(odd, odd_rows, weak):
    digest = (lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)) if weak else exact_stream.sha256_digest
    got = rows_of(exact_stream.copies(odd, digest), "doc_id", "keep_id", "group_size", "kept")
    groups = {}
    for i, t in odd_rows:
        groups.setdefault(fold(t), []).append(i)
    want = []
    for i, t in odd_rows:
        own = groups[fold(t)]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep))
    assert got == sorted(want, key=repr)


def test_copies_stage(odd, odd_rows, empty):
    kept = exact_stream.without_copies(odd)
    assert kept.columns == odd.columns
    texts = [fold(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({fold(t) for _, t in odd_rows})
    assert exact_stream.copies(empty).count() == 0 and exact_stream.without_copies(empty).count() == 0


def test_state_goes_on_after_a_restart(spark, tmp_path):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "state"))
    first = exact_stream.records(frame(spark, rows[:30]))
    first.repartition(3).write.parquet(source)
    exact_stream.run_stream(spark, source, first.schema, out, check, files_per_trigger=1)
    exact_stream.records(frame(spark, rows[30:])).repartition(2).write.mode("append").parquet(source)
    exact_stream.run_stream(spark, source, first.schema, out, check, files_per_trigger=1)
    got = {(r.keeper.doc_id, r.group_size) for r in exact_stream.registry(spark, out).collect()}
    want = {(max(i for i, t in rows if t == f"text {k}"), sum(t == f"text {k}" for _, t in rows)) for k in range(7)}
    assert got == want


# 4 secrets

SLOW = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    spans = [(m.start(), 0, m.end()) for m in SLOW.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secret_spans(spark, odd, odd_rows, empty):
    rng = random.Random(3)
    pieces = ["password", "PASSWD", "token", "secret=", ": ", "=", '"', "'", "abcdefgh", "a1B2c3D4e5", "AKIA", "ABCD1234", "deadbeef" * 3,
              " ", "é", "api_key", "ApiKey", ".", "ſecret"]
    rows = odd_rows + [(1000 + i, "".join(rng.choice(pieces) for _ in range(rng.randrange(20)))) for i in range(400)]
    got = rows_of(guess_cost.scan(frame(spark, rows), WORD_FILE), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    want = []
    for i, t in rows:
        s = base_spans(t or "")
        joined = ",".join(f"{guess_cost.KINDS[k]}:{a}:{b}" for a, k, b in s)
        want.append((i, *[sum(x[1] == k for x in s) for k in range(3)], hashlib.sha256(joined.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert guess_cost.scan(empty, WORD_FILE).count() == 0


def test_guess_cost_is_the_least_over_all_cuts():
    words = {"pass": 1.0, "word": 2.0, "horse": 2.5}

    def whole(value):
        """Cost of one span by itself."""
        return guess_cost.guess_cost(value, words)

    assert whole("password") < whole("pxsswqrd") and whole("aaaaaaaa") < whole("aqxmzvkt")
    assert whole("20240131") < whole("83920174") and whole("qwertyui") < whole("qmxbtvzi")
    assert whole("abcabcabcabc") < whole("abqtmzpvwdfk") and whole("p4ssword") < whole("p7sswqrd")
    rng = random.Random(4)
    for _ in range(50):
        value = "".join(rng.choice("passwordhorse123") for _ in range(12))
        for cut in range(1, 12):
            # An own switch is paid for each part, but the pool of a part may be smaller than that of the whole.
            if guess_cost._pool(value[:cut]) == guess_cost._pool(value[cut:]) == guess_cost._pool(value):
                assert whole(value) <= whole(value[:cut]) + whole(value[cut:]) + 1e-9
    assert whole("x" * 50 + "Kq9" * 400) > 0 and whole("") == 0.0


def test_values_of_one_class_and_quoted_values():
    words = guess_cost.load_words(WORD_FILE)
    for text, value in (
            ("pwd=xkqjvzwmptblr", "xkqjvzwmptblr"), ("passphrase: qzxjvkwpbnmtr", "qzxjvkwpbnmtr"),
            ("api-key: 83749201837465920183", "83749201837465920183"), ("password is xkqjvzwmptblr", "xkqjvzwmptblr"),
            ("pwd=!#%&*^~|!#%&", "!#%&*^~|!#%&"), ('pwd="aB3,kd;92x!"', "aB3,kd;92x!"), ("pwd='k<3>q zB,x'", "k<3>q zB,x"),
            ('pwd="aB3\\"kd;92x!" and more', 'aB3\\"kd;92x!'), ('pwd="aB3,kd;92x!\nxkqjvzwm', None), ('pwd="aB3xkd92xq\nnext', "aB3xkd92xq"),
            ("login: authentication", None), ("password is incorrect", None), ("pwd=qwertyuiop", None), ("pwd: 20240131", None)):
        found = [text[a:b] for a, k, b in guess_cost.find_spans(text, words) if k == 3]
        assert found == ([value] if value else []), text
        if value:
            assert value not in guess_cost.mask_spans(text, guess_cost.find_spans(text, words))


def test_masked_keeps_rows_and_columns(odd, odd_rows):
    out = guess_cost.masked(odd, WORD_FILE)
    assert out.columns == odd.columns and out.count() == len(odd_rows)
    text = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert "Tr0ub4dor" not in text[16][0] and "AKIA" not in text[16][0] and text[16][1] == len(text[16][0])
    assert text[1] == (None, None) and text[8][0] == dict(odd_rows)[8]
    assert [r.text for r in out.where("doc_id = 8").collect()] == [dict(odd_rows)[8]]


# 5 tokens

def test_tokens_equal_the_library(odd, odd_rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(WORD_FILE)
    got = rows_of(stream_bpe.digests(odd, WORD_FILE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in odd_rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert stream_bpe.digests(empty, WORD_FILE).count() == 0


def test_stream_equals_whole_word():
    rng = random.Random(6)
    merges = stream_bpe.Merges(WORD_FILE)
    for _ in range(40):
        word = "".join(rng.choice(["in", "th", "an", "the", "ing", "x", "st", "ation", "s", "é"]) for _ in range(rng.randrange(10, 2500))).encode()
        ids = [merges.inner[b] for b in word]
        ids[-1] = merges.last[word[-1]]
        assert list(merges.stream(word)) == merges.merge(ids)


def test_decoders_round_trip():
    enc = stream_bpe.Encoder(WORD_FILE, memory=5)
    text = "naïve 三字 don't stop"
    ids = enc.encode(text)
    plain = stream_bpe.TextDecoder(enc.merges)
    assert ("".join(plain.feed([i]) for i in ids) + plain.finish()).split() == "naïve 三字 don 't stop".split()
    chunks = [text[i:i + 3] for i in range(0, len(text), 3)]
    assert list(enc.encode_stream(chunks)) == ids
    one, all_ = stream_bpe.PieceDecoder(enc.merges), stream_bpe.PieceDecoder(enc.merges)
    assert b"".join(one.feed([i]) for i in ids) == all_.feed(ids)


# 6 fingerprints

def test_edited_texts_and_equal_fingerprints(spark, odd_rows, empty):
    rows = [(i, t) for i, t in dict(odd_rows).items() if i is not None]
    got = {r.doc_id: r for r in imatch.edited_fingerprints(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    by_text = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        if edited == t:
            assert got[i].near_edited == 1.0
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        pairs = list(zip(got[i].fingerprint.split("."), got[order[(k + 1) % len(order)][0]].fingerprint.split(".")))
        some = sum(a != "-" or b != "-" for a, b in pairs)
        assert got[i].near_next == pytest.approx(sum(a == b != "-" for a, b in pairs) / some if some else 1.0)
    # Texts of the same terms are alike; no others are here.
    assert len(set(by_text.values())) == len({frozenset(regex.findall(r"[\p{L}\p{N}]+", t.lower())) for t in by_text})
    assert imatch.edited_fingerprints(empty).count() == 0
    assert imatch.edited_fingerprints(frame(spark, [(1, "alone here")])).first().near_next == 1.0


def test_signatures_against_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(1, 120), 400)) for i in range(80)] + [(90, ""), (91, None), (92, "Straße ÉTÉ 42 été")]

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def hashed(values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), h)
        return h

    cells = 1 << imatch.CELL_BITS
    terms = {i: sorted({signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w})
             for i, t in rows}
    counts = Counter(c for own in terms.values() for c in {t % cells for t in own})
    low, high = (b * len(rows) for b in imatch.BAND)
    want = {}
    for i, own in terms.items():
        band, out, shift = [t for t in own if low <= counts[t % cells] <= high], [], imatch.CELL_BITS
        for bits in imatch.THINNING:
            for j in range(imatch.PER_LEVEL):
                kept = [t for t in band if (t >> shift) % (1 << bits) == j]
                out.append(f"{hashed(kept):x}" if kept else "-")
            shift += bits
        want[i] = ".".join(out if band else [f"{hashed(own):x}"] + ["-"] * (len(out) - 1))
    assert any("-" not in w.split(".")[:7] for w in want.values())
    got = {r.doc_id: r.fingerprint for r in imatch.edited_fingerprints(frame(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("coarse", [1_024, 4])
def test_next_row_over_many_ranges(spark, monkeypatch, coarse):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 7)
    monkeypatch.setattr(imatch, "COARSE", coarse)
    rng = random.Random(8)
    ids = rng.sample(range(1000), 120)
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in imatch.with_next(docs, ["text"]).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_nulls_and_repeats_have_fingerprints(odd, odd_rows):
    assert imatch.edited_fingerprints(odd).count() == len(odd_rows)


# 7 packing

def test_pieces_cover_every_document(odd, odd_rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(BYTE_FILE)
    ids = [np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for _, t in odd_rows]
    pieces = harmonic_pack.pack(odd, BYTE_FILE).collect()
    want = Counter((i, zlib.crc32(x.tobytes()), len(x)) for (i, _), x in zip(odd_rows, ids))
    whole = {(i, len(x)): x for (i, _), x in zip(odd_rows, ids)}
    got_tokens = Counter()
    for p in pieces:
        x = [y for (i, n), y in whole.items() if i == p.doc_id and n == p.doc_tokens]
        assert any(zlib.crc32(y[p.start:p.start + p.length].tobytes()) == p.ids_crc32 for y in x)
        got_tokens[(p.doc_id, p.doc_tokens)] += p.length
    assert got_tokens == Counter({(i, n): n * sum(c for (a, _, b), c in want.items() if (a, b) == (i, n)) for i, _, n in want})
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    padding = sum(0 if (n := sum(x for _, x in s)) & (n - 1) == 0 else 1024 - n for s in by_sequence.values())
    assert padding <= 0.02 * sum(map(len, ids))
    assert harmonic_pack.pack(empty, BYTE_FILE).count() == 0


def test_long_white_space():
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(BYTE_FILE)
    encode = harmonic_pack.byte_encoder(BYTE_FILE)
    long = 1_200_000
    for text in (" " * long, "a b" + " " * long + "c d", "x" + "\n" * long + "y", " \t" * (long // 2) + "<|endoftext|> z", "\u3000" * 150_000 + "é",
                 "one" + " " * 100_000 + "\x1c two", "\n" * 100_000 + " " + " " * 99_999, "p" + " " * 99_999 + "q"):
        assert encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_cut_lengths():
    sizes = harmonic_pack.slot_sizes()
    for n in range(1, 3000):
        pieces = harmonic_pack.cut(n, sizes)
        assert sum(pieces) == n and all(p in sizes or p < sizes[-1] for p in pieces)


# 8 repeated strings

def slow_removed(rows, length=50):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        octets = (t or "").encode()
        rank = (1 << 63) - 1 if i is None else i
        gone = np.zeros(len(octets), bool)
        for at in range(len(octets) - length + 1):
            if seen.setdefault(octets[at:at + length], rank) < rank:
                gone[at:at + length] = True
        kept = bytes(b for b, g in zip(octets, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(octets), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(odd, odd_rows, empty):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(suffix_merge.removed(odd), *columns) == slow_removed(odd_rows)
    assert suffix_merge.removed(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_with_shared_passages(spark, monkeypatch, seed):
    monkeypatch.setattr(suffix_merge, "SLAB", 700)
    monkeypatch.setattr(suffix_merge, "SMALL_IDS", 0 if seed == 1 else 10)
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(45, 140))) for _ in range(6)] + ["ab" * 60, "x" * 90]
    rows = []
    for i in range(90):
        text = ""
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            cut = rng.randrange(20)
            text += p[cut:len(p) - rng.randrange(20)] + "".join(rng.choice("klmno") for _ in range(rng.randrange(30)))
        rows.append((i, text))
    docs = frame(spark, rows).repartition(5)
    assert rows_of(suffix_merge.removed(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == slow_removed(rows)


def test_pairs_and_windows_agree(monkeypatch):
    rng = random.Random(12)
    for _ in range(200):
        base = bytes(rng.choice(b"ab") for _ in range(suffix_merge.WIDTH))
        keys = set()
        for _ in range(rng.randrange(2, 9)):
            key = bytearray(base)
            for at in rng.sample(range(suffix_merge.GRAM, suffix_merge.WIDTH), rng.randrange(3)):
                key[at] = 99
            after, before = rng.randrange(30, 51), rng.randrange(20, 35)
            key[after:50] = b"\xff" * (50 - after)
            key[50 + before:] = b"\xff" * (34 - before)
            keys.add(bytes(key))
        entries = []
        for n, key in enumerate(sorted(keys)):
            refs = np.zeros(1, suffix_merge.REF)
            refs["doc"], refs["place"] = rng.randrange(4), 100 * (n + 1)
            entries.append((key, suffix_merge.GRAM, refs))
        got = []
        for few in (100, 1):
            monkeypatch.setattr(suffix_merge, "FEW", few)
            covers = suffix_merge.Covers()
            covers.take(iter(entries))
            got.append(sorted(map(tuple, covers.rows().to_numpy().tolist())))
        assert got[0] == got[1]


def test_merge_of_runs_never_loses_order():
    rng = random.Random(9)
    runs, every = [], []
    for r in range(5):
        keys = sorted(bytes(rng.choice(b"ab") for _ in range(suffix_merge.WIDTH)) for _ in range(rng.randrange(40)))
        keys = sorted(keys + keys[:3])
        every += keys
        if keys:
            arr = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)
            runs.append(suffix_merge.read_run(suffix_merge.encode_run(arr, np.zeros(len(keys), suffix_merge.REF))))
    before, count = None, 0
    for key, known, refs in suffix_merge.merge_runs(runs):
        if before is not None:
            assert before <= key and known == suffix_merge.common(before, key, 0)
        before, count = key, count + len(refs)
    assert count == len(every)


# 9 near copies

def slow_fingerprint(text, words):
    own = re.findall("[^\x20\x09-\x0D]+", fold(text))
    if not own:
        return 0
    shingles = [" ".join(own[i:i + words]) for i in range(max(1, len(own) - words + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(fps, bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_near_groups(odd, odd_rows, empty):
    fps = [slow_fingerprint(t, 4) for _, t in odd_rows]
    groups = slow_groups(fps)
    least = {}
    for g, (i, _) in zip(groups, odd_rows):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted(((i, f - (1 << 64) if f >> 63 else f, least.get(g)) for (i, _), f, g in zip(odd_rows, fps, groups)), key=repr)
    assert rows_of(simhash_blocks.near_groups(odd), "doc_id", "fp", "component_id") == want
    assert simhash_blocks.near_groups(empty).count() == 0


def shingle_set(text, words=5):
    own = fold(text).split()
    return {" ".join(own[i:i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def distinct_fingerprint(text):
    own = set(re.findall("[^\x20\x09-\x0D]+", fold(text)))
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_copies_go(spark, odd, odd_rows, empty):
    rng = random.Random(31)
    rows = [(i, t) for i, t in odd_rows if i is not None]
    for i in range(40):
        words = prose(rng, 150, 5000).split()
        rows.append((1000 + 10 * i, " ".join(words)))
        for k in range(1, 4):
            own = list(words)
            for at in rng.sample(range(150), k + 1):
                own[at] = f"new{rng.randrange(10**6)}"
            rows.append((1000 + 10 * i + k, " ".join(own)))
    docs = frame(spark, rows).repartition(4)
    close, distinct = [slow_fingerprint(t, 5) for _, t in rows], [distinct_fingerprint(t) for _, t in rows]
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            near = (close[i] ^ close[j]).bit_count() <= 4
            both = len(sets[i] & sets[j])
            if near or (distinct[i] ^ distinct[j]).bit_count() <= 6 and both and 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    want = sorted({least[find(i)] for i in range(len(rows))})
    kept = simhash_blocks.drop_near(docs)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}) == want
    caught = sum(d not in want for d, _ in rows if d >= 1000 and d % 10)
    assert caught >= 60 and all(1000 + 10 * i in want for i in range(40))
    assert simhash_blocks.drop_near(odd).where("doc_id is null").count() == sum(i is None for i, _ in odd_rows)
    assert simhash_blocks.drop_near(empty).count() == 0


def test_near_copies_under_several_hashes(spark):
    """Pairs at the similarity bound, where a single fingerprint of the words is often too far off."""
    rng = random.Random(77)
    rows = []
    for i in range(60):
        words = prose(rng, 90, 5000).split()
        own = list(words)
        at = rng.randrange(90 - 6)
        own[at:at + 5] = [f"new{rng.randrange(10**6)}" for _ in range(5)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(own))]

    def fp(text, seed):
        return simhash_blocks.fingerprint(text, 0, seed)

    near = [(slow_fingerprint(a, 5) ^ slow_fingerprint(b, 5)).bit_count() <= 4 for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    caught = [[n or any((fp(a, s) ^ fp(b, s)).bit_count() <= 6 for s in simhash_blocks.SEEDS[:k])
               for n, (_, a), (_, b) in zip(near, rows[::2], rows[1::2])] for k in (1, 3)]
    sets = [shingle_set(t) for _, t in rows]
    assert all(9 * len(a & b) >= 4 * (len(a) + len(b)) for a, b in zip(sets[::2], sets[1::2]))
    kept = {r.doc_id for r in simhash_blocks.drop_near(frame(spark, rows).repartition(4), seeds=simhash_blocks.SEEDS).collect()}
    assert kept == {10 * i for i in range(60)} | {10 * i + 1 for i in range(60) if not caught[1][i]}
    assert sum(caught[1]) >= 50 and sum(caught[1]) >= sum(caught[0]) + 5


def test_near_copies_of_permuted_words_go(spark):
    """Texts of one word set in several orders, each with near copies of the same words or a few others."""
    from txnlens.llm.common import components

    rng = random.Random(41)
    rows = []
    for i in range(4):
        words = list(dict.fromkeys(prose(rng, 130, 5000).split()))
        for k in range(3):
            rng.shuffle(words)
            swapped = list(words)
            for at in (20, 100):
                swapped[at], swapped[at + 1] = swapped[at + 1], swapped[at]
            rows += [(100 * i + 10 * k, " ".join(words)), (100 * i + 10 * k + 1, " ".join(swapped)),
                     (100 * i + 10 * k + 2, " ".join(["other", *words[1:]]))]
    links = simhash_blocks.similar_links(frame(spark, rows).repartition(4))
    found = {r.node: r.root for r in components(links.toDF("a", "b")).collect()}
    texts, near = dict(rows), {}
    for i, _ in rows:
        near[i] = min(j for j in texts if j // 10 == i // 10 and (j == i or (
            len(shingle_set(texts[i]) & shingle_set(texts[j])) * 9 >= 4 * (len(shingle_set(texts[i])) + len(shingle_set(texts[j])))
            and (distinct_fingerprint(texts[i]) ^ distinct_fingerprint(texts[j])).bit_count() <= 6)))
    assert {i: found.get(i, i) for i in texts} == near
    assert all(near[i] == i - 1 for i in texts if i % 10 == 1)


def near_components(rows):
    """The least id of the group of each row, by brute force over all pairs."""
    close, distinct = [slow_fingerprint(t, 5) for _, t in rows], [distinct_fingerprint(t) for _, t in rows]
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and ((close[i] ^ close[j]).bit_count() <= 4 or (distinct[i] ^ distinct[j]).bit_count() <= 6 and (
                    9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])))):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_near_copies_in_large_groups(spark, monkeypatch):
    """Families of variants, some only similar by way of others, and long texts of the same words that have no passage in common."""
    rng = random.Random(43)
    rows = []
    for i in range(4):
        words = prose(rng, 150, 5000).split()
        rows.append((1000 * i, " ".join(words)))
        for k in range(1, 40):
            own = list(words)
            for at in rng.sample(range(150), 1 + k % 4):
                own[at] = f"new{rng.randrange(10**6)}"
            rows.append((1000 * i + k, " ".join(own)))
    words = [f"w{k % 300}" for k in range(3000)]
    for k in range(30):
        rng.shuffle(words)
        rows.append((9000 + k, " ".join(words)))
    own, seen = simhash_blocks.similar, []

    def counted(docs, nodes, pairs, words):
        seen.append(pairs.count())
        return own(docs, nodes, pairs, words)

    monkeypatch.setattr(simhash_blocks, "similar", counted)
    kept = {r.doc_id for r in simhash_blocks.drop_near(frame(spark, rows).repartition(4)).collect()}
    groups = near_components(rows)
    assert kept == set(groups.values()) and len({g for g in groups.values() if g < 9000}) > 4
    # Of 435 pairs of long texts none is worth a look; a family of 40 has 780 pairs, a forest of it 39.
    assert sum(seen) < 2 * len(rows)


def test_close_pairs_and_forests(monkeypatch):
    """Pairs of a group, cut further or not, and a spanning forest of them against brute force."""
    rng = random.Random(44)
    fps = []
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(30):
            y = x
            for b in rng.sample(range(9, 64), rng.randrange(6)):
                y ^= 1 << b
            fps.append(y & ~511)
    f = np.array(fps, np.uint64)
    want = {(i, j) for i in range(len(f)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 6}
    monkeypatch.setattr(simhash_blocks, "ROWS_AT_ONCE", 16)
    for most in (1000, 20):
        monkeypatch.setattr(simhash_blocks, "BRUTE_NODES", most)
        got = [(max(i, j), min(i, j)) for a, b in simhash_blocks.close_pairs(f, 6, 511) for i, j in zip(a.tolist(), b.tolist())]
        assert set(got) == want and len(got) == len(want)
    a, b = (np.array(x) for x in zip(*sorted(want)))
    x, y, w = simhash_blocks.spanning(a, b, np.array([(fps[i] ^ fps[j]).bit_count() for i, j in zip(a, b)], float))

    def parts(edges):
        root = list(range(len(f)))
        for i, j in edges:
            old, new = root[i], root[j]
            root = [new if r == old else r for r in root]
        return [root.index(r) for r in root]

    assert parts(zip(x.tolist(), y.tolist())) == parts(want) and len(x) == len(f) - len(set(parts(want)))
    assert (np.diff(w) >= 0).all()


@pytest.mark.parametrize("sizes", [(50, 60), (120, 130), (4000, 4900), (20, 5000)])
def test_parities(sizes):
    """No more bits apart than shingles, whatever their lengths; far more than similar texts for texts that share nothing."""
    rng = np.random.default_rng(45)
    every = rng.integers(0, 1 << 63, 2 * sum(sizes), dtype=np.uint64)
    one = [every[:n] for n in sizes]
    sets = [*one, np.concatenate([one[0][5:], every[-5:]]), every[-sizes[0]:]]
    apart = lambda i, j: int(simhash_blocks.bits_apart(
        [simhash_blocks.parity(np.unique(s)) for s in sets], np.array([i]), np.array([j]))[0])
    assert apart(0, 0) == 0 and apart(0, 1) == apart(1, 0) <= sizes[1] - sizes[0] and apart(0, 2) <= 10
    assert 9 * apart(0, 3) > 2 * sizes[0]


def test_links_over_chains(spark):
    """Long chains, tight clouds and blocks of any number give the components of all pairs."""
    rng = random.Random(10)
    fps = set()
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
    fps |= {rng.getrandbits(64) for _ in range(60)}
    own = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    groups = slow_groups([x % (1 << 64) for x in own])
    want = sorted(((x, own[g]) for x, g in zip(own, groups)))
    nodes = spark.createDataFrame([(x,) for x in own], "fp long")
    from txnlens.llm.common import components

    for count in (len(own), 1 << 40):
        got = {r.node: r.root for r in components(simhash_blocks.links(nodes, count)).collect()}
        assert sorted((x, got.get(x, x)) for x in own) == want


# 10 lines

def slow_lines(rows):
    every = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            words = frozenset(regex.findall(r"[\p{L}\p{N}]+", line.lower()))
            if words:
                every.append(((-(1 << 63) if i is None else i, k), words))
    every.sort(key=lambda x: x[0])
    gone = set()
    for n, (place, words) in enumerate(every):
        if any(9 * len(words & other) >= 4 * (len(words) + len(other)) for p, other in every[:n] if p < place):
            gone.add(place)
    return gone


@pytest.mark.parametrize("seed", range(2))
def test_lines(spark, odd_rows, empty, seed):
    rng = random.Random(20 + seed)
    lines = [prose(rng, rng.randrange(1, 14), 25) for _ in range(25)]
    rows = [(i, t) for i, t in dict(odd_rows).items()]
    for i in range(60):
        own = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choice(lines).split()
            if rng.random() < 0.6:
                words[rng.randrange(len(words))] = f"w{rng.randrange(40)}"
            own.append(" ".join(words))
        rows.append((500 + i, "\n".join(own)))
    docs = frame(spark, rows).repartition(4)
    got = {r.doc_id: r for r in line_join.decisions(docs).collect()}
    gone = slow_lines(rows)
    for i, t in rows:
        rank = -(1 << 63) if i is None else i
        want = sorted(k for d, k in gone if d == rank)
        assert got[i].removed == want and got[i].n_removed == len(want) and got[i].n_lines == (t or "").count("\n") + 1
    kept = line_join.without_lines(docs)
    assert kept.columns == docs.columns
    text = {r.doc_id: r.text for r in kept.collect()}
    for i, t in rows:
        rank = -(1 << 63) if i is None else i
        own = [line for k, line in enumerate((t or "").split("\n")) if (rank, k) not in gone]
        assert text[i] == (t if t is None or len(own) == t.count("\n") + 1 else "\n".join(own))
    assert line_join.decisions(empty).count() == 0


@pytest.mark.parametrize("step", [1, 1 << 52])
def test_lines_meet_by_couples(spark, monkeypatch, step):
    """Long lines of words that many lines have meet only if they may be similar; ids may be too far apart for one long."""
    rng = random.Random(52)
    lines = [prose(rng, rng.randrange(55, 120), 5000) for _ in range(300)]
    for k in range(40):
        words = lines[k].split()
        for at in rng.sample(range(len(words)), rng.randrange(1, 14)):
            words[at] = f"new{rng.randrange(10**6)}"
        lines.append(" ".join(rng.sample(words, len(words))))
    rows = [((i - 170) * step, line) for i, line in enumerate(lines)] + [(None, lines[5]), (900 * step, lines[7] + "\n" + lines[7])]
    own, sizes = line_join.kept_table, {}

    def counted(df, name):
        table, path = own(df, name)
        sizes[name] = sizes.get(name, 0) + table.count()
        return table, path

    monkeypatch.setattr(line_join, "kept_table", counted)
    got = {r.doc_id: r.removed for r in line_join.decisions(frame(spark, rows).repartition(4)).collect()}
    gone = slow_lines(rows)
    assert got == {i: sorted(k for d, k in gone if d == (-(1 << 63) if i is None else i)) for i, _ in rows}
    assert 10 < len(gone) < 50
    # Most of 340 lines share several of their rarest words with others, a near copy about twenty couples.
    assert sum(n for name, n in sizes.items() if name not in ("line-rows", "line-distinct", "line-keys")) < 2500
