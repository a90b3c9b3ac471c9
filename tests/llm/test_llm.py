"""Operators against brute force on small tables with awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tablewise.llm import media, packing, suffix_dedup, token_files
from tablewise.llm.batches import buffer_of
from tablewise.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, part int"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "de", "ki", "lo", "mu", "sé", "tra"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage, base = prose(rng, 60), prose(rng, 200)
    texts = [None, "", "  \n", "one", "One Two", base, base, base.upper(), base.replace("ba", "bo", 1), prose(rng, 9000)]
    texts += [prose(rng, 30) + " " + passage + ".\n" + prose(rng, 20) for _ in range(6)] + [passage, "x" * 500, "x" * 700]
    texts += [prose(rng, rng.randint(1, 80)) for _ in range(40)]
    out = [(i * 3, t, "en" if i % 2 else None, "s", 1, 9, "z", 4) for i, t in enumerate(texts)]
    return out + [out[5], (None, base + " tail", "en", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


# --- 1


def brute_repeats(rows, length):
    docs = sorted(((math.inf if i is None else i, (t or "").encode()) for i, t in {(r[0], r[1]) for r in rows}))
    least = {}
    for i, b in docs:
        for s in range(len(b) - length + 1):
            least.setdefault(b[s : s + length], i)
    out = {}
    for i, b in docs:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if least[b[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for x in bytes(gone).split(b"\0") if x)
        out[None if i == math.inf else i, b] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [256, 0])
def test_suffix_dedup_equals_brute_force(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_PARTS", hot)
    want = Counter((k[0], *v) for k, v in brute_repeats(rows, 50).items())
    want[(15, *brute_repeats(rows, 50)[15, rows[5][1].encode()])] += 1  # the repeated row
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == want


def test_a_line_of_many_unlike_texts_sends_little_text(spark, monkeypatch):
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    line, passage = letters(80), letters(400)
    texts = [(i, letters(300) + line + letters(300)) for i in range(60)]
    texts += [(60 + i, letters(90) + passage[:200] + line + passage[200:] + letters(90)) for i in range(3)]
    texts += [(70 + i, line) for i in range(3)] + [(80, None), (None, line), texts[1]]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix_dedup, "HOT_PARTS", 0)
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 0, raising=False)
    want = Counter((i, t or "", *brute_repeats(texts, 200)[i, (t or "").encode()]) for i, t in texts)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, 200).collect())
    assert got == Counter((k[0], *k[2:]) for k in want.elements())
    assert sum(r.n_removed > 0 for r in suffix_dedup.remove_repeats(docs, 200).collect()) == 2

    def sent(length):
        def run(table):
            size = sum(len(t) for t in table["texts"].to_pylist() if t is not None)
            return pa.table({"part": pa.array([size], pa.int32()), **{c: pa.array([b""]) for c in ("docs", "starts", "windows")}})

        return run

    monkeypatch.setattr(suffix_dedup, "_repeats", sent)
    spans = suffix_dedup._repeated_spans(docs, 200, "doc_id", "text")[1]
    # the 281 windows of the passage, from each of three parts at most
    assert spans.agg({"part": "sum"}).first()[0] <= 3 * 281 * 200


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(3)
    for trial in range(40):
        raw = rng.integers(97, 99 + trial % 3, 300).astype(np.uint8)
        raw[100:160] = raw[10:70]
        places = np.arange(230)
        depth = int(rng.integers(25, 60))
        order, group = suffix_dedup.sort_suffixes(np.concatenate([raw, np.zeros(64, np.uint8)]), places, depth)
        keys = [raw[p : p + depth].tobytes() for p in places[order].tolist()]
        assert keys == sorted(keys)
        assert all((a == b) == (keys[i] == keys[i + 1]) for i, (a, b) in enumerate(zip(group[:-1], group[1:])))


def test_cut_repeats_keeps_rows_and_columns(docs, empty):
    cut = suffix_dedup.cut_repeats(docs, 200, size_col="n_chars")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.where("doc_id = 0").first().text is None
    assert suffix_dedup.cut_repeats(empty, 200).count() == 0 and suffix_dedup.remove_repeats(empty).count() == 0


# --- 2


def test_sharding(docs, rows, empty):
    from tablewise.llm.sharding import shard_documents

    eight = {s: 1.0 for s in range(8)}
    found = shard_documents(docs, eight, eight | {8: 1.0}).collect()
    assert len(found) == len(rows)
    for shard in range(8):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 8) for r in found)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r["size"] == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in found)
    assert shard_documents(empty, eight, eight).count() == 0


def test_weights_share_out_keys(spark):
    from tablewise.llm.sharding import rendezvous

    counts = spark.range(40_000).groupBy(rendezvous(__import__("pyspark.sql.functions", fromlist=["col"]).col("id"), {0: 1, 1: 3}).alias("s")).count()
    n = {r.s: r["count"] for r in counts.collect()}
    assert abs(n[1] / 40_000 - 0.75) < 0.01


# --- 3 and 8


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def test_encoder_equals_whole_text_encoding(tokenizer):
    from tablewise.llm.tokens import Encoder

    rng = random.Random(2)
    alphabet = "ab é×÷.,'\n\t 　  \u0085—12's!\r\x1c<|endoftext|>ÀÉ中"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", "  a", "don't  go."]
    ids, at = Encoder(tokenizer_path()).encode(*buffer_of(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 5, 11, 16, 17, 24])
def test_bit_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 4096, 10_001):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        frame = token_files.pack_frame(ids, bits)
        assert (token_files.read_frame(frame) == ids).all()
        for a, b in ((0, n), (3, 5), (4090, 4100), (n - 1, n)):
            assert (token_files.read_frame(frame, max(a, 0), b) == ids[max(a, 0) : b]).all()


def test_token_files_in_key_order(spark, docs, rows, empty, tokenizer):
    folder = token_files.scratch_token_files(docs, tokenizer_path())
    found = sorted(token_files.read_token_index(spark, folder).collect(), key=lambda r: r.start)
    keys = [r.doc_id for r in found]
    assert keys == sorted(keys, key=lambda k: -1 if k is None else k) and len(found) == len(rows)
    at, texts = 0, {r[0]: r[1] or "" for r in rows}
    for r in found:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: r.ids[-1] for r in token_files.read_tokens(spark, folder).collect()} == {k: 0 for k in keys}
    assert token_files.read_token_index(spark, token_files.scratch_token_files(empty, tokenizer_path())).count() == 0


def test_packing(docs, rows, empty, tokenizer):
    found = packing.pack_documents(docs, tokenizer_path()).collect()
    used = {}
    texts = {r[0]: r[1] or "" for r in rows}
    for r in found:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
        piece = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
        assert bytes(r.ids) == piece and r.ids_crc32 == zlib.crc32(piece) and r.doc_tokens == len(ids)
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in found) == sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_counted_rules_equal_piecewise_best_fit():
    rng = random.Random(4)
    for _ in range(30):
        top = rng.choice([10, 64, 100])
        lengths = sorted((rng.randint(1, top) for _ in range(300)), reverse=True)
        bins = []
        for n in lengths:
            fit = [b for b in bins if sum(b) + n <= top]
            if fit:
                max(fit, key=sum).append(n)
            else:
                bins.append([n])
        sizes = {}
        for length, first, end, window, each, _ in packing.best_fit_rules(Counter(lengths), top):
            for rank in range(first, end):
                sizes.setdefault(window + (rank - first) // each, []).append(length)
        # windows with equal room are alike, whatever fills them
        assert Counter(map(sum, sizes.values())) == Counter(map(sum, bins))


# --- 5, 6, 7


def test_toxicity_learns_expressions(spark, empty):
    from tablewise.llm.toxicity import fit_toxicity, score_toxicity

    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        text = prose(rng, 60).split()
        if bad:
            text[10:10], text[30:30] = [rng.choice(["zog", "wozk"])], ["quxx" + rng.choice("abcde")]
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(docs, marks, learn=__import__("pyspark.sql.functions", fromlist=["col"]).col("doc_id") < 400)
    held = [r for r in score_toxicity(docs, model).collect() if r.doc_id >= 400]
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in held)
    assert score_toxicity(empty, model).count() == 0
    nothing = fit_toxicity(empty, marks.limit(0))
    assert {r.predicted for r in score_toxicity(docs.limit(5), nothing).collect()} == {0}


def test_language_families_and_pairs(spark, empty):
    from tablewise.llm.language import fit_language, predict_language

    rng = random.Random(3)
    parts = {"en": ["th", "ing", "ou"], "de": ["sch", "ung", "ei"], "fr": ["eau", "oi", "que"], "es": ["ción", "ll", "os"]}
    rows = [(i, " ".join("".join(rng.choice(parts[g]) for _ in range(3)) for _ in range(20)), g) for i, g in enumerate(list(parts) * 60)]
    rows += [(900, None, "en"), (901, "12 34!", "fr"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language(docs, learn=__import__("pyspark.sql.functions", fromlist=["col"]).col("doc_id") < 160)
    found = {r.doc_id: r for r in predict_language(docs, model).collect()}
    assert all(found[i].lang_pred == g for i, _, g in rows[160:240])
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (900, 901, 902))
    assert predict_language(empty, model).count() == 0
    assert {r.lang_pred for r in predict_language(docs.limit(9), fit_language(empty)).collect()} == {"und"}


def test_suffix_tree_counts_and_base(docs, rows, empty):
    from tablewise.llm.suffix_tree import score_texts
    from tablewise.llm.toxicity import fold

    found = score_texts(docs, fold(7) != 2).collect()
    learned, counts = [], Counter()
    for r in rows:
        held = r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 == 2
        learned.append(held)
        if not held:
            counts.update([*words(r[1]), None])
    total, kinds = sum(counts.values()), len(counts)
    want = {}
    for r, held in zip(rows, learned):
        tokens = [*words(r[1]), None]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)
        want[r[0]] = (held, len(tokens), sum(counts[w] > 0 for w in tokens), total, base)
    assert len(found) == len(rows)
    for r in found:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0
    assert score_texts(empty, fold(7) != 2).count() == 0


def test_suffix_tree_is_a_distribution():
    from tablewise.llm.suffix_tree import grow_tree

    rng = np.random.default_rng(0)
    levels = {}
    for depth in range(3):
        keys = np.unique(rng.integers(97, 100, (400, depth + 1)) @ (256 ** np.arange(depth, -1, -1)))
        levels[depth] = (keys.astype(np.uint64), rng.integers(1, 900, len(keys)))
    tree = grow_tree(levels)
    for context in (0, 97, 98 << 8 | 99, 120):
        keys = np.array([context << 8 | b for b in range(256)], np.uint64)
        assert (10 ** tree.symbol_logs(keys)).sum() == pytest.approx(1, abs=1e-6)


# --- 9, 10, near copies


def brute_fingerprint(text, width):
    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < width else [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs, rows, empty):
    from tablewise.llm.simhash import near_duplicates

    found = near_duplicates(docs).collect()
    prints = {r[0]: brute_fingerprint(r[1], 3) for r in rows}
    assert all(r.fingerprint % 2**64 == prints[r.doc_id] for r in found) and len(found) == len(rows)
    group = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    low = min((g for g in (group[a], group[b]) if g is not None), default=None)
                    if group[a] != low or group[b] != low:
                        group[a] = group[b] = low
                        changed = True
    assert all(r.component_id == group[r.doc_id] for r in found)
    assert near_duplicates(empty).count() == 0


def test_long_lists_lose_no_link(monkeypatch):
    from tablewise.llm import simhash

    rng = np.random.default_rng(1)
    block = simhash.position_blocks()[0]
    assert len(simhash.position_blocks()) == 14
    free = [8 * p + b for p in range(8) if p not in block[:3] + (block[3],) and p != 7 for b in range(8)][:24]
    values = np.unique(np.array([sum(1 << f for f in free if rng.random() < 0.15) for _ in range(600)], np.uint64))
    short = {tuple(x) for x in simhash.list_links(values, 3, None).tolist()}
    monkeypatch.setattr(simhash, "LIST_LIMIT", 1)
    assert {tuple(x) for x in simhash.list_links(values, 3, free).tolist()} == short


def test_decontamination_equals_brute_force(spark, docs, rows, empty):
    from tablewise.llm.decontaminate import contaminated, drop_contaminated

    rng = random.Random(8)
    long = words(rows[9][1])
    items = [(1, b" ".join(long[50:80]).decode()), (2, b" ".join(long[500:520]).decode().upper()), (3, prose(rng, 25)), (4, "One two"), (5, None), (6, "")]
    changed = long[900:960]
    changed[3] = b"other"
    items.append((7, b" ".join(changed).decode()))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for r in rows:
        w = words(r[1])
        for item, text in items:
            v = words(text)
            if not v:
                continue
            k = min(5, len(v))
            own = Counter(tuple(v[i : i + k]) for i in range(len(v) - k + 1))
            for s in range(len(w) - len(v) + 1):
                window = Counter(tuple(w[s + i : s + i + k]) for i in range(len(v) - k + 1))
                if sum((own & window).values()) >= 0.8 * sum((own | window).values()):
                    want.add((r[0], item))
                    break
    found = contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) >= 3
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {k for k, _ in want}
    assert contaminated(empty, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_near_copies(spark, empty):
    from tablewise.llm.near_copies import keep_first, near_copies

    rng = random.Random(6)
    texts = [prose(rng, 120) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " more") for i, t in enumerate(texts)] + [(200, texts[0]), (201, None), (202, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_copies(docs).collect()}
    assert all(found[100 + i] == i for i in range(20)) and found[200] == 0 and found[202] == 201
    assert {r.doc_id for r in keep_first(docs).collect()} == {*range(20), 201}
    assert near_copies(empty).count() == 0


def brute_components(rows, width=5, similarity=0.8):
    sets = {}
    for key, text in rows:
        w = words(text)
        n = min(width, len(w)) or 1
        sets[key] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    group = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    return group


def test_near_copies_lose_no_link_above_the_limit(spark, monkeypatch):
    from tablewise.llm import near_copies

    rng = random.Random(12)
    rows = []
    for i in range(60):
        base = prose(rng, 150).split()
        rows.append((10 * i, " ".join(base)))
        for k in range(1, 4):  # up to four changed words: similarities of about 0.76 to 0.87
            other = list(base)
            for at in rng.sample(range(6, 144), rng.choice((2, 3, 4))):
                other[at] = f"x{rng.randrange(10**9)}"
            rows.append((10 * i + k, " ".join(other)))
    want = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == want
    assert 60 < len(set(want.values())) < 240
    # the same by way of leaders
    monkeypatch.setattr(near_copies, "LIST_LIMIT", 1)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == want


def test_pairs_of_linked_components_are_spared(spark):
    from tablewise.llm.near_copies import _still_apart

    pairs = [(11, 21, 1, 2), (12, 22, 1, 2), (11, 31, 1, 3), (21, 31, 2, 3), (31, 41, 3, 4)]
    pairs = spark.createDataFrame(pairs, "a long, b long, ca long, cb long")
    for links, want in (
        ([], {(11, 21), (12, 22), (11, 31), (21, 31), (31, 41)}),
        ([(1, 2)], {(11, 31), (21, 31), (31, 41)}),
        ([(1, 2), (2, 3)], {(31, 41)}),  # by way of a third one
    ):
        links = spark.createDataFrame(links, "a long, b long")
        assert {tuple(r) for r in _still_apart(pairs, links).collect()} == want


def test_near_copies_are_alike_by_sets_only(spark):
    from tablewise.llm.near_copies import keep_first, near_copies

    rng = random.Random(13)
    line = "one two three four five six seven "
    # the same line 60 times, then words of each text's own
    rows = [(i, line * 60 + prose(rng, 40)) for i in range(4)]
    # equal sets, other repeat counts: the first sixty words once or nine times
    cycle = prose(rng, 60) + " "
    tail = prose(rng, 300)
    rows += [(10, cycle * 2 + tail), (11, cycle * 9 + tail)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in near_copies(docs).collect()} == want
    assert want == {0: 0, 1: 1, 2: 2, 3: 3, 10: 10, 11: 10}
    assert {r.doc_id for r in keep_first(docs).collect()} == {0, 1, 2, 3, 10}


# --- 4


def test_images(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(12):
        shades = np.kron(rng.integers(0, 256, (20, 20)), np.ones((4, 4)))
        pixels = media._box(shades[None].astype(np.float32), 1)[0]
        rows.append((i, media.write_pgm(pixels)))
        rows.append((100 + i, media.write_pgm(pixels[6:70, 3:75])))
        rows.append((200 + i, media.write_pgm(np.rot90(pixels) * 0.9 + 12)))
    rows += [(300, None), (301, b"no picture"), (302, rows[0][1]), (303, b"P5 0 0 255\n")]
    images = spark.createDataFrame(rows, "image_id long, image binary")
    found = {r.image_id: r for r in media.image_classes(images).collect()}
    assert len(found) == len(rows)
    assert sum(found[100 + i].class_id == i for i in range(12)) >= 11 and sum(found[200 + i].class_id == i for i in range(12)) >= 11
    assert found[302].class_id == 0 and found[301].class_id == 301 and found[300].n_links == 0
    assert all(found[i].class_id == i for i in range(12))
    assert media.image_classes(images.limit(0)).count() == 0


# --- pipeline


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "packing":
            assert docs.columns == columns
            assert 0 < docs.count() <= before
    assert docs.agg({"length": "max"}).first()[0] <= 2048


def test_sketches_bound_the_difference():
    from tablewise.llm.near_copies import sketch, sketch_distance

    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 250, 257, 3000):
        for m in (0, 1, 300, 5000):
            for part in (0.0, 0.7, 1.0):
                x = rng.integers(0, 2**64, n, np.uint64)
                y = np.concatenate([x[: int(part * n)], rng.integers(0, 2**64, m, np.uint64)])
                apart = len(np.setxor1d(x, y))
                assert sketch_distance(sketch(np.unique(x)), sketch(np.unique(y))) <= apart


def test_pipeline_stages_with_awkward_rows(spark, rows):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    schema = SCHEMA + ", _toxicity double, node long, home int, _TOXICITY_ string"
    docs = spark.createDataFrame([(*r, 0.5, 1, 2, "t") for r in rows], schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, folder)
        assert stage(spark, docs.limit(0), folder).count() == 0
        if name == "packing":
            ends = kept.where("start = 0").count()
            assert ends == len(rows) and kept.where("doc_id is null").count() >= 1
            continue
        assert kept.columns == docs.columns
        found = kept.select("doc_id", "shard", "_toxicity", "node").collect()
        assert all(tuple(r)[1:] == (9, 0.5, 1) for r in found)
        # rows without a key or a text stay
        assert None in {r.doc_id for r in found} and {0, 3} & {r.doc_id for r in found}


def test_header_of_many_digits_is_no_picture():
    assert media.read_pnm(b"P5 " + b"9" * 5000 + b" 1 255\n0") is None
    assert media.read_pnm(b"P5 2 1 255\n\x01\x02").tolist() == [[1.0, 2.0]]
