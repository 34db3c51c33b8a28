"""Edit embedding against a walk step by step, and fingerprints of next and edited documents."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from letterflow.llm import edit_fingerprint as ef

SCHEMA = "doc_id long, text string, part string, copied int"


def slow_symbols(text):
    kinds = ef._kinds(text)
    steps = ef._walk().reshape(ef.PERIOD, ef.KINDS) // ef.KINDS
    embedding, j = [], 0
    for c in kinds:
        stay = int(steps[j % ef.PERIOD, c])
        embedding += [c] * stay
        j += stay
    at, slot, _ = ef._samples(ef.scale_of(len(kinds)))
    out = [ef.END] * ef.BITS
    for step, k in zip(at, slot):
        if step < len(embedding):
            out[k] = embedding[step]
    return out


def texts():
    rng = random.Random(2)
    made = ["".join(rng.choice("abcde ü") for _ in range(rng.randrange(0, 1500))) for _ in range(20)]
    return made + ["", "a", "ab", "abc", "é😀x", "日本語" * 50, "x" * 5000]


def test_side_by_side_equals_one_by_one():
    got = ef.sampled_symbols([ef._kinds(t) for t in texts()])
    assert [list(row) for row in got] == [slow_symbols(t) for t in texts()]


def test_company_does_not_matter():
    scales, bits = ef.fingerprints(texts())
    for t, s, b in zip(texts(), scales, bits):
        one_scale, one_bits = ef.fingerprints([t])
        assert one_scale[0] == s and np.array_equal(one_bits[0], b)


def test_scales_share_steps_of_common_octaves():
    for scale in (9, 12, 16):
        _, slot_a, name_a = ef._samples(scale)
        _, slot_b, name_b = ef._samples(scale + 1)
        a, b = np.empty(ef.BITS, int), np.empty(ef.BITS, int)
        a[slot_a], b[slot_b] = name_a, name_b
        assert np.array_equal(a[:64], b[128:192])


def test_likeness_falls_with_edits():
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    means = []
    for edits in (0, 3, 30, 300):
        made = []
        for _ in range(12):
            y = list(base)
            for _ in range(edits):
                y[rng.randrange(len(y))] = rng.choice(["", "zz", "q"])
            made.append("".join(y))
        scales, bits = ef.fingerprints([base, *made])
        n = len(made)
        means.append(ef.likeness(np.repeat(scales[:1], n), np.repeat(bits[:1], n, axis=0), scales[1:], bits[1:]).mean())
    assert means[0] == 1 and means[1] > 0.7 and sorted(means, reverse=True) == means and means[3] < 0.5


def brute(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    out = []
    for k, (doc, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        changed = ef.edited(text, following)
        scales, bits = ef.fingerprints([text, changed, following])
        names = ef.as_text(scales, bits)
        near = [round(float(ef.likeness(scales[:1], bits[:1], scales[i:i + 1], bits[i:i + 1])[0]), 9) for i in (1, 2)]
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), names[0], names[1], *near))
    return sorted(out, key=repr)


def collected(docs):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in ef.compare_with_next(docs).collect()), key=repr)


def test_next_documents_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ef, "PART_DOCS", 7)
    monkeypatch.setattr(ef, "BLOCK_CHARS", 4000)
    rng = random.Random(1)
    rows = [(k * 13 % 101, t) for k, t in enumerate(texts() + [None, "tail" * 40])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "clash", 4) for r in rows], SCHEMA).repartition(3)
    assert collected(docs) == brute(rows)


def test_repeated_ids_nulls_one_row_and_none(spark):
    rows = [(5, "bb"), (5, "aa"), (None, "cc"), (2, None), (9, "dddd"), (9, "dddd")]
    assert collected(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)) == brute(rows)
    assert collected(spark.createDataFrame([(1, "alone", None, None)], SCHEMA)) == brute([(1, "alone")])
    assert collected(spark.createDataFrame([], SCHEMA)) == []


def test_a_common_id_is_cut_by_its_texts(spark, monkeypatch):
    """A third of the rows without doc_id, a third with one, ends of the range of ids, copies; no part holds a group."""
    monkeypatch.setattr(ef, "PART_DOCS", 10)
    rng = random.Random(6)
    words = lambda: "".join(rng.choice("abcé\x00 ") for _ in range(rng.randrange(0, 60)))
    rows = [(doc, words()) for doc in [None] * 100 + [(1 << 62) + 1] * 100 + list(range(90))]
    rows += [(None, "a" * 50 + x) for x in "cba"] * 2 + [((1 << 63) - 1, "top"), (-(1 << 63), None), (None, "")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA).repartition(3)

    def sizes(batches):
        """One row for each part that a task holds: how many rows it has, in n_chars."""
        seen = {}
        for batch in batches:
            for part in batch.column("part").to_pylist():
                seen[part] = seen.get(part, 0) + 1
        n = pa.array(list(seen.values()), pa.int64())
        text, number = pa.array([""] * len(n), pa.string()), pa.array([0.0] * len(n), pa.float64())
        yield pa.RecordBatch.from_arrays([n, n, text, text, text, number, number], names=[
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    assert collected(docs) == brute(rows)
    monkeypatch.setattr(ef, "_compared", sizes)
    held = [r["n_chars"] for r in ef.compare_with_next(docs).select("n_chars").collect()]
    assert sum(held) >= len(rows) and max(held) <= 50 and len(held) > 10


def test_edited_text():
    assert ef.edited("abcdef", "XYZUVW") == "abcXYZ"
    assert ef.edited("abcde", "X") == "abcX" and ef.edited("", "X") == "" and ef.edited("a", "X") == "a"


def test_alike_groups(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1200))
    close = base[:700] + "q" + base[701:]
    other = "".join(rng.choice("abcdefgh ") for _ in range(1200))
    rows = [(4, base), (2, close), (7, base), (9, other), (None, base), (11, None), (10, "")]
    got = {(r["doc_id"]): r["group_id"] for r in ef.alike(
        spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA), 0.7).collect()}
    assert got == {4: 2, 2: 2, 7: 2, 9: 9, None: None, 11: 10, 10: 10}
    assert ef.alike(spark.createDataFrame([], SCHEMA)).collect() == []


def near(x, y):
    (a, b), bits = ef.fingerprints([x, y])
    got = [float(ef.likeness(np.array([s]), bits[i:i + 1], np.array([t]), bits[j:j + 1])[0])
           for s, i, t, j in ((a, 0, b, 1), (b, 1, a, 0))]
    assert got[0] == got[1]
    return got[0]


def noise(rng, n):
    return "".join(rng.choice("abcdefgh ") for _ in range(n))


def test_a_power_of_two_between_near_copies_changes_little():
    rng = random.Random(31)
    for n in (256, 1024, 4096):
        got = [near(base, base[:k] + "q" + base[k:]) for base in (noise(rng, n) for _ in range(6))
               for k in (n // 3, n - 9, n)]
        assert np.mean(got) > 0.8 and np.median(got) > 0.9, got
        cut = [near(base, base[:n * 3 // 4]) for base in (noise(rng, n + n // 8) for _ in range(6))]
        assert 0.5 < np.mean(cut) < 0.8, cut


def test_unrelated_texts_are_not_alike_whatever_their_length():
    rng = random.Random(32)
    for n in (1030, 1100, 1280, 1500, 2040):
        got = [near(noise(rng, n), noise(rng, n + 3)) for _ in range(12)]
        assert np.mean(got) < 0.25 and max(got) < 0.45, (n, got)
    assert near("", "") == 1 and near("", "abc") == 0 and near("a", "") == 0 and near("abc", "abc") == 1


def test_bands_meet_across_scales_and_rarely_by_chance():
    rng = random.Random(33)
    bases = [noise(rng, n) for n in (1016, 1020, 1024, 1026, 1060, 1100) * 8]
    copies = [b[:200] + "q" + b[203:] + "abcdefgh"[:rng.randrange(9)] for b in bases]
    cut = [b[:len(b) * 9 // 10] for b in bases]
    scales, bits = ef.fingerprints(bases + copies + cut)
    keys = [set(k) for k in ef._band_keys(scales, bits, 0.8)]
    n = len(bases)
    crossed = 0
    for i in range(n):
        for j in (i + n, i + 2 * n):
            if ef.likeness(scales[i:i + 1], bits[i:i + 1], scales[j:j + 1], bits[j:j + 1])[0] >= 0.8:
                crossed += scales[i] != scales[j]
                assert keys[i] & keys[j]
    assert crossed > 10
    chance = [bool(keys[i] & keys[j]) for i in range(n) for j in range(i)]
    assert np.mean(chance) < 0.25


def test_alike_groups_across_a_power_of_two(spark):
    rng = random.Random(34)
    rows = []
    for k, n in enumerate((512, 1024, 2048)):
        base = noise(rng, n)
        rows += [(10 * k + 1, base), (10 * k + 2, base + "q"), (10 * k + 3, noise(rng, n + 20))]
    got = {r["doc_id"]: r["group_id"] for r in ef.alike(
        spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA), 0.8).collect()}
    assert got == {10 * k + i: 10 * k + (3 if i == 3 else 1) for k in range(3) for i in (1, 2, 3)}
