"""Parts of the operators against plain forms of the same thing."""

import io
import random
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ticketspark.llm import bagminhash, bitsliced, maxent_lm, mixing, simple8b, substring_dedup, toxicity, warc
from ticketspark.llm.common import WORD
from ticketspark.llm.components import components
from ticketspark.llm.word_hash import CHUNK, Words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0bé日.", max_size=30)), max_size=8)


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    words = Words(pa.array(texts, pa.string()))
    plain = [WORD.findall(t or "") for t in texts]
    assert words.counts.tolist() == [len(w) for w in plain]
    spelled = [words.raw[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends, strict=True)]
    assert spelled == [w for ws in plain for w in ws]
    by_word = {}
    assert all(by_word.setdefault(w, h) == h for w, h in zip(spelled, words.hashes.tolist(), strict=True))
    assert len(set(by_word.values())) == len(by_word)
    assert words.joined(np.ones(len(words), bool)).to_pylist() == [" ".join(w) for w in plain]
    keep = np.arange(len(words)) % 3 != 1
    flags = iter(keep)
    assert words.joined(keep).to_pylist() == [" ".join([w for w in ws if next(flags)]) for ws in plain]


def test_words_over_chunks():
    text = "x" * (CHUNK - 3) + " abcdefgh " + "y " * 10
    words = Words(pa.array([None, text, "abcdefgh"]))
    assert words.counts.tolist() == [0, 12, 1] and words.hashes[1] == words.hashes[-1]
    assert words.runs(np.array([2, 3]), 5).tolist() == [words.runs(np.array([2]), 5)[0]] * 2


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2 ** 64 - 1)), max_size=300), st.integers(1, 50))
@settings(max_examples=80, deadline=None)
def test_simple8b_round_trip(values, block):
    made = simple8b.pack(np.array(values, np.uint64), block)
    assert [n for _, _, n, _ in made] == [len(values[i:i + block]) for i in range(0, len(values), block)]
    raws = [np.frombuffer(raw, "<u8") for raw, _, _, _ in made]
    words = [r[:w] for r, (_, w, _, _) in zip(raws, made, strict=True)]
    escapes = [r[w:] for r, (_, w, _, _) in zip(raws, made, strict=True)]
    if values:
        assert simple8b.unpack(np.concatenate(words), np.concatenate(escapes)).tolist() == values


def test_simple8b_file_ranges(tmp_path):
    random.seed(1)
    docs = [[random.choice([1, 300, 2 ** 62]) for _ in range(random.choice([0, 1, 50, 9000]))] for _ in range(40)]
    writer = simple8b.Writer(str(tmp_path / "a.s8b"), flush_at=simple8b.BLOCK)
    for i, ids in enumerate(docs):
        writer.add(i, np.array(ids, np.uint64))
    assert writer.close()["n_values"] == sum(map(len, docs))
    reader = simple8b.Reader(str(tmp_path / "a.s8b"))
    flat = [x for d in docs for x in d]
    for lo, hi in ((0, len(flat)), (5, 5), (4095, 4097), (17, 9999), (len(flat) - 3, len(flat))):
        assert reader.read(lo, hi).tolist() == flat[lo:hi]
    got = [(i, ids[a - s[0]:].tolist()) for ids_, s, ids in reader.documents(1000) for i, a in zip(ids_.tolist(), s.tolist(), strict=True)]
    assert [i for i, _ in got] == list(range(40))


class Memory:
    def __init__(self, raw):
        self.raw = raw

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        return self.raw[at:at + n]


@pytest.mark.parametrize("limit", [1 << 31, 10])
@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 not the end"])
def test_zip_directories(monkeypatch, limit, comment):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    out = io.BytesIO(b"front" * 3)
    out.seek(0, 2)
    with zipfile.ZipFile(out, "a", zipfile.ZIP_STORED) as z:
        z.writestr("archive/data.warc.gz", b"0123456789" * 9)
        z.writestr("indexes/index.cdx", b'x {"offset": 10, "length": 20, "filename": "archive/data.warc.gz"}\n')
        z.writestr("é", b"packed" * 99, zipfile.ZIP_DEFLATED)
        z.comment = comment
    raw = out.getvalue()
    assert (warc.END64 in raw) == (limit == 10)
    file = Memory(raw)
    place, length = warc.locate(file)[0]
    assert raw[place:place + length] == b"0123456789" * 2
    with pytest.raises(ValueError, match="not stored"):
        warc.stored(file, warc.directory(file), "é")
    with pytest.raises(ValueError):
        warc.directory(Memory(b"no zip at all"))


def test_cover_property():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_bit_sliced_block():
    random_ = np.random.default_rng(1)
    values = random_.integers(-400, 400, (70, 5))
    table = pa.table({"block": [0] * 70, "dims": pa.array([5] * 70, pa.int32()), "vec_id": list(range(70)), "q": values.tolist()})
    low, width = int(values.min()), int(values.max() - values.min()).bit_length()
    bits = np.stack([((values - low).T >> b) & 1 for b in range(width)], 1).astype(np.uint8)
    packed = np.zeros((5, width, 16), np.uint8)
    packed[:, :, :9] = np.packbits(bits, axis=2, bitorder="little")
    queries = np.array([[1, -2, 300, 0, -7], [0, 0, 0, 0, 0], [-1024, 1023, 5, 5, 5]])
    for q, ids, scores in bitsliced.search_block(np.arange(70), low, packed.view(np.uint64), np.array([3, 999, 0]), queries, 10):
        query = queries[[3, 999, 0].index(q)]
        want = sorted((-int(values[i] @ query), i) for i in range(70) if i != q)[:10]
        assert sorted(zip((-scores).tolist(), ids.tolist(), strict=True)) == want
    assert len(table) == 70


def plain_similarity(a, b):
    def bag(text):
        w = WORD.findall(text)
        return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_bagminhash_is_unbiased():
    random.seed(2)
    words = [f"w{random.randrange(40)}" for _ in range(600)]
    other = [w if random.random() > 0.02 else "z" for w in words]
    # Heavy multiplicities reach the wide ranges.
    pairs = [(" ".join(words), " ".join(other)), ("a b c d e " * 300, "a b c d e " * 200), ("x " * 40, "x " * 29)]
    for a, b in pairs:
        want = plain_similarity(a, b)
        assert bagminhash.similarities(pa.array([a]), pa.array([b]))[0] == pytest.approx(want)
        w = Words(pa.array([a, b]))
        made = bagminhash.registers(*bagminhash.shingle_counts(w), 2, 8192)
        assert np.isfinite(made).all() and (made[0] == made[1]).mean() == pytest.approx(want, abs=0.025)


def test_components(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(30)] + [(100, j) for j in range(101, 160)] + [(random.randrange(200, 260), random.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for x in parent if find(x) != x}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_near_groups_need_few_comparisons(spark):
    """A large group of near copies and a chain of texts are one class each, without all pairs."""
    random.seed(4)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(3):
            words[random.randrange(300)] = f"e{random.randrange(10 ** 6)}"
        rows.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(400)]
    for i in range(12):
        rows.append((1000 + i, " ".join(chain[i * 8:i * 8 + 200])))
    documents, _, links = bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    text = dict(rows)
    parent = {i: i for i in text}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(text)
    for a in ids:
        for b in ids:
            if a < b and plain_similarity(text[a], text[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {r.doc_id: r.class_id for r in documents.collect()} == {i: find(i) for i in ids}
    assert links.count() < 150 * 12


def test_mixing_against_plain_form(spark):
    random.seed(5)
    rows = [(i, random.choice(["big"] * 8 + ["mid"] * 3 + ["small"]), " ".join(["w"] * random.randrange(1, 30))) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    tokens = {i: t.count("w") for i, _, t in rows}
    of = {}
    for i, s, _ in rows:
        of[s] = of.get(s, 0) + tokens[i]
    total = sum(of.values())

    def at(a):
        z = sum((t / total) ** a for t in of.values())
        w = {s: (t / total) ** a / z for s, t in of.items()}
        return w, -sum(x * np.log(x) for x in w.values()), max(w[s] * total / t for s, t in of.items())

    grid = [i / 20_000 for i in range(20_001)]
    flat = max(a for a in grid if at(a)[1] >= 0.95 * np.log(3))
    few = min(a for a in grid if at(a)[2] <= 2.0)
    for target, repeats, want in ((0.95, 99.0, flat), (0.95, 2.0, max(flat, few))):
        got = mixing.mix_sources(frame, target, repeats, block_tokens=500).collect()
        weights = at(want)[0]
        for s in of:
            mine = sorted((r.start, r.n_tokens, r.epoch, r.doc_id) for r in got if r.source == s)
            quota = weights[s] * total
            # Contiguous, epoch by epoch, until the quota is reached.
            assert all(a[0] + a[1] == b[0] for a, b in zip(mine, mine[1:], strict=False)) and mine[0][0] == 0
            assert abs(mine[-1][0] + mine[-1][1] - quota) <= 30 + quota * 0.01
            counts = Counter(d for _, _, _, d in mine)
            assert max(counts.values()) - min(counts.get(i, 0) for i, x, _ in rows if x == s) <= 1


def test_language_model_sums_to_one():
    """P(class | context) and P(word | class) with one unknown place per shape are distributions."""
    weights = np.random.default_rng(1).normal(0, 1, (maxent_lm.ROWS, maxent_lm.CLASSES)).astype(np.float32)
    logs = maxent_lm.log_shares(np.arange(5), weights, np.zeros(maxent_lm.CLASSES, np.float32))
    assert np.exp(logs).sum(1) == pytest.approx(1, abs=1e-4)


def test_language_model_gradient():
    random_ = np.random.default_rng(2)
    keys = np.unique(random_.integers(0, 50 * maxent_lm.CLASSES, 300)).astype("<u4")
    counts = random_.integers(1, 9, len(keys))
    weights = random_.normal(0, 0.5, (maxent_lm.ROWS, maxent_lm.CLASSES)).astype(np.float64)
    bias = np.zeros(maxent_lm.CLASSES)
    g, _, value = maxent_lm.gradient(keys, counts, weights, bias, int(counts.sum()))
    row, column = np.unravel_index(np.abs(g).argmax(), g.shape)
    moved = weights.copy()
    moved[row, column] += 1e-4
    _, _, higher = maxent_lm.gradient(keys, counts, moved, bias, int(counts.sum()))
    assert (higher - value) / 1e-4 == pytest.approx(g[row, column], rel=1e-2)


def test_toxicity_of_misspellings():
    random.seed(6)
    plain = [f"{a}{b}" for a in ("mal", "ten", "gor", "ish", "pra", "lun") for b in ("de", "ka", "ro", "sit", "um", "ven")]
    bad = ["wretchful", "snivelbag", "crumbler"]
    rows = []
    for i in range(600):
        words = random.choices(plain, k=random.randrange(5, 200))
        label = int(i % 4 == 0)
        if label:
            words[random.randrange(len(words))] = random.choice(bad)
        rows.append((" ".join(words), label))
    weights = toxicity.fit(rows)
    score = toxicity.Scorer(*toxicity.margins(weights))
    filler = " ".join(random.choices(plain, k=300))
    assert score(f"{filler} wretchful {filler}") > 0.5 > score(filler)
    assert score("wretchfull malde") > score("malde tenka") and score("crumbller") > score("gorum")
    assert 0 <= score("") < 0.5 and toxicity.fit([("a b", 1)]) is None and toxicity.fit([]) is None
