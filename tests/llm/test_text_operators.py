"""Each text operator against a plain version in Python, on small tables with nulls, blanks, long texts, ties and clashing columns."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import bpe, chat, mixing, packing, quality, resample, simhash, subword, substring, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, fp int, k string, __drop int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, start=0):
    return " ".join(f"w{i:04d}x" for i in range(start, start + n))


@pytest.fixture(scope="module")
def rows():
    long = words(12_000, 5_000)
    passage = words(70, 100)
    return [
        (1, words(120), "en", "a"), (2, words(120), "en", "a"), (3, words(119) + " changed", "en", "a"), (4, None, "en", None), (5, "", None, "a"),
        (6, " \n\t ", "en", "a"), (7, long, "en", "b"), (8, words(40, 900) + " " + passage + " " + words(40, 1_000), "en", "b"),
        (9, words(40, 1_100) + "\n" + passage + "\n" + words(40, 1_200), "de", "b"), (10, "x" * 60_000, "de", "b"), (11, "same " * 300, "de", "b"),
        (12, "é ü 日本語 <|im_end|> 1½ don't  end ", "fr", "c"), (None, words(90, 3_000), "fr", "c"), (13, words(30, 4_000), "fr", "c"), (13, words(30, 4_000), "fr", "c"),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "s", 1, "k", 2) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_bpe_equals_the_library(docs, rows, empty):
    library = bpe.codec(bpe.rank_file()).library
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect())
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(empty).count() == 0
    back = bpe.decode_docs(bpe.encode_docs(docs)).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") and r.n_tokens == len(r.token_ids) for r in back)


def test_bpe_replaces_columns_of_its_names(spark):
    df = spark.createDataFrame([(1, "some text", 9, "t", "d"), (1, "some text", 9, "t", "d"), (None, None, 9, "t", "d")], "doc_id long, text string, N_TOKENS int, token_ids string, decoded string")
    for out in (bpe.encode_docs(df), bpe.encode_checked(df)):
        assert out.columns == ["doc_id", "text", "decoded", "token_ids", "n_tokens"]
        assert sorted(r.n_tokens for r in out.collect()) == [0, 2, 2]
    assert {bytes(r.decoded) for r in bpe.decode_docs(bpe.encode_docs(df)).collect()} == {b"", b"some text"}


def test_bpe_pieces_are_safe(monkeypatch):
    rng = np.random.default_rng(1)
    alphabet = list("ab 's'llé1½!,.\n\t \x1c\x85　  日\r")
    library = bpe.codec(bpe.rank_file()).library
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 50))) for _ in range(3_000)]
    for long in (20_000, 3):
        monkeypatch.setattr(bpe, "LONG", long)
        monkeypatch.setattr(bpe, "PIECE", 30 if long == 3 else 400_000)
        ids, at = bpe.encode_column(pa.array(texts), bpe.rank_file())
        assert all(ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(t) for i, t in enumerate(texts))
    for t in ("a" * 100_000, " " * 100_000 + "b", "ab1" * 30_000):
        assert bpe.codec(bpe.rank_file()).encode(t).tolist() == library.encode_ordinary(t)


def test_packing_keeps_every_token(docs, rows, empty):
    library = bpe.codec(bpe.rank_file()).library
    for length in (64, 2_048):
        parts = {}
        for r in packing.pack(docs, length).collect():
            assert len(r.ids) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and set(r.ids[r.n_tokens :]) <= {packing.PAD}
            assert r.position_resets == r.cu_seqlens[:-1] + ([r.n_tokens] if r.n_tokens < length else [])
            assert packing.positions(r.position_resets, length)[r.cu_seqlens[:-1]].tolist() == [0] * len(r.doc_ids)
            for j, (d, s) in enumerate(zip(r.doc_ids, r.doc_starts, strict=True)):
                parts.setdefault(d, []).append((s, r.ids[r.cu_seqlens[j] : r.cu_seqlens[j + 1]]))
        for i, t, *_ in rows:
            want = library.encode_ordinary(t or "")
            got = parts.get(i, [])
            copies = 2 if i == 13 else 1
            assert sum(len(x) for _, x in got) == copies * len(want)
            assert [y for _, x in sorted(dict((s, x) for s, x in got).items()) for y in x] == want
    assert packing.pack(empty).count() == 0


def test_best_fit_takes_the_fullest_row():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 65, 400).tolist()
    free, rows = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [j for j in range(len(free)) if free[j] >= sizes[i]]
        if fit:
            j = min(fit, key=lambda j: free[j])
            free[j] -= sizes[i]
        else:
            free.append(64 - sizes[i])
    rows = packing.best_fit_decreasing(sizes, 64)
    assert sorted(i for r in rows for i in r) == list(range(400)) and all(sum(sizes[i] for i in r) <= 64 for r in rows)
    assert sorted(64 - sum(sizes[i] for i in r) for r in rows) == sorted(free)


def test_packed_binaries(spark, docs, tmp_path):
    packed = packing.pack(docs, 128)
    packing.write_binary(packed, f"file://{tmp_path}/packed")
    back = {r.pack_id: np.frombuffer(r.ids, r.dtype).tolist() for r in spark.read.parquet(f"file://{tmp_path}/packed").collect()}
    assert back == {r.pack_id: r.ids for r in packed.collect()}


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = WORD.findall(low)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_components(docs, rows, empty):
    fps = {i: slow_fingerprint(t) for i, t, *_ in rows}
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {i: f for i, (f, _) in got.items()} == fps
    label = {i: i for i in fps if i is not None}
    for _ in label:
        label = {a: min(label[b] for b in label if (fps[a] ^ fps[b]).bit_count() <= 4) for a in label}
    assert {i: c for i, (_, c) in got.items() if i is not None} == label
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(label.values()))
    assert sum(r.doc_id is None for r in kept.collect()) == 1


def test_one_of_each_tells_rows_of_one_id_apart(spark, monkeypatch):
    a, b = words(200), words(200, 5_000)
    rows = [(1, a), (1, b), (1, a), (2, a), (3, b), (None, a), (None, a), (4, words(90, 8_000)), (5, None), (6, " ")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, `a.b` string, __drop int")
    want = sorted([(1, a), (1, b), (4, words(90, 8_000)), (5, None), (None, a), (None, a)], key=repr)
    for bound in (simhash.DROPPED_ROWS, 0):
        monkeypatch.setattr(simhash, "DROPPED_ROWS", bound)
        out = simhash.one_of_each(df)
        assert out.columns == df.columns and sorted([(r.doc_id, r.text) for r in out.collect()], key=repr) == want


@pytest.mark.parametrize("keys", [3])
def test_components_with_hubs(spark, monkeypatch, keys):
    from tessera.llm import common, components

    monkeypatch.setattr(common, "HOT_KEYS", keys)
    pairs = [(0, i) for i in range(1, 300)] + [(1_000 + i, 1_001 + i) for i in range(60)] + [(2_000, i) for i in range(2_001, 2_100)] + [(299, 1_060), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 300)}, **{i: 0 for i in range(1_000, 1_061)}, **{i: 2_000 for i in range(2_001, 2_100)}}


@pytest.mark.parametrize("block", [8_192, 7])
def test_simhash_links_all_pairs_within_reach(spark, block):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [s ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) for s in seeds for k in (1, 3, 4, 5, 7)]
    cloud = [seeds[0] ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(8, 3).astype(np.uint64)) for _ in range(200)]
    fps = np.unique(np.concatenate((seeds, near, cloud)).astype(np.uint64))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(nodes, 4, block)).collect()}
    label, near = fps.view(np.int64).copy(), np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    while not np.array_equal(label, new := np.where(near, label[None, :], np.iinfo(np.int64).max).min(1)):
        label = new
    assert [got.get(int(x), int(x)) for x in fps.view(np.int64)] == label.tolist()


def test_simhash_thresholds():
    rng = np.random.default_rng(4)
    for m in (2, 3, 4, 5):
        cost = np.sort(rng.random((m, 6, 50)), axis=1)
        cost[:, 0] = 0
        t = simhash.allocate(cost, 4)
        assert (t.sum(0) == 4 - m + 1).all() and (t >= -1).all()
        paid = np.take_along_axis(cost, (t + 1)[:, None, :].astype(int), 1)[:, 0].sum(0)
        import itertools

        every = [c for c in itertools.product(range(-1, 5), repeat=m) if sum(c) == 4 - m + 1]
        assert np.allclose(paid, np.min([sum(cost[i, c[i] + 1] for i in range(m)) for c in every], axis=0))
    assert sorted(b for g in simhash.correlated_groups(10, rng.random((64, 64)), 5) for b in g) == list(range(64))


def test_substring_removes_later_occurrences(docs, rows, empty):
    got = {r.doc_id: r for r in substring.substring_dedup(docs).collect()}
    text = {i: t for i, t, *_ in rows}
    for i, r in got.items():
        raw, out, at = (text[i] or "").encode(), b"", 0
        for s in r.removed_spans:
            out, at = out + raw[at : s.start], s.end
        assert (out + raw[at:]).decode() == (r.text or "") and (r.text is None) == (text[i] is None)
    assert got[1].removed_words == 0 and got[2].text == "" and got[3].text == "changed"
    kept = words(40, 900) + " " + words(70, 100) + " " + words(40, 1_000)
    assert got[8].text in (kept, words(40, 900) + " " + words(50, 120) + " " + words(40, 1_000))
    assert got[9].text == words(40, 1_100) + "\n" + words(40, 1_200)
    assert got[7].removed_words == 0 and got[None].removed_words == 0 and got[13].removed_words == 0
    assert got[11].removed_words == 0  # a word that one text repeats is no passage
    assert substring.substring_dedup(empty).count() == 0
    assert substring.cleaned(docs).columns == docs.columns


def test_substring_finds_every_long_repeat(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = [rng.choice(vocabulary, 300).tolist() for _ in range(60)]
    for i in range(30, 60):  # a passage of 50 to 90 words from an earlier text, anywhere
        n, source = int(rng.integers(50, 91)), texts[int(rng.integers(0, 30))]
        at, to = int(rng.integers(0, 300 - n)), int(rng.integers(0, 300))
        texts[i][to:to] = source[at : at + n]
    df = spark.createDataFrame([(i, " ".join(t).replace(" ", "\n", 1)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in substring.substring_dedup(df).collect()}
    assert all(got[i].removed_words == 0 for i in range(30)) and all(got[i].removed_words >= 50 for i in range(30, 60))
    seen = set()
    for i in range(60):
        w = got[i].text.split()
        own = {" ".join(w[j : j + 50]) for j in range(len(w) - 49)}
        assert not own & seen
        seen |= own


def slow_left(texts, least=50):
    """Words left of each text: a word goes if a run of `least` words around it occurs in an earlier text."""
    seen, out = set(), []
    for t in texts:
        w = t.split()
        runs = [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
        gone = {j for i, r in enumerate(runs) if r in seen for j in range(i, i + least)}
        seen.update(runs)
        out.append([x for j, x in enumerate(w) if j not in gone])
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_substring_does_not_depend_on_the_first_occurrence(spark, partitions):
    rng = np.random.default_rng(10)
    new = lambda n: [f"n{x}" for x in rng.integers(0, 1 << 40, n)]
    sentences, whole = [], []
    for _ in range(60):  # a 30-word sentence alone, then two texts that share it with 10 more words on either side
        s, before, after = new(30), new(10), new(10)
        sentences.append(new(25) + s + new(25))
        whole += [new(40) + before + s + after + new(40), new(40) + before + s + after + new(40)]
        whole.append(new(30) + s + after + new(10) + s[:15])  # and one that shares 40 words only
    texts = [" ".join(t) for t in sentences + whole]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    got = {r.doc_id: r.text.split() for r in substring.substring_dedup(df).collect()}
    want = slow_left(texts)
    assert sum(len(t.split()) - len(w) for t, w in zip(texts, want, strict=True)) == 60 * 50
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("partitions", [1, 5])
def test_substring_rows_that_repeat_an_id(spark, partitions):
    twice, other, late = words(200, 100), words(60, 700) + " " + words(80, 900), words(60, 800)
    rows = [(1, twice), (1, twice), (2, words(60, 700)), (3, other), (3, late), (3, late), (4, twice)]
    got = sorted((r.doc_id, r.text, r.removed_words) for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)).collect())
    assert got == sorted([(1, twice, 0), (1, twice, 0), (2, words(60, 700), 0), (3, words(80, 900), 60), (3, late, 0), (3, late, 0), (4, "", 200)])


def test_substring_repeats_within_a_text(spark):
    rng = np.random.default_rng(12)
    new = lambda n: " ".join(f"n{x}" for x in rng.integers(0, 1 << 40, n))
    long, line, short, shout = new(60), new(30), new(30), " ".join(["THE!!"] * 180)
    again = f"{long}\n{new(20)}\n{long.upper()}\n{line}\n{line}\n{line}\n{long}"
    periodic = " ".join([short] * 8)
    df = spark.createDataFrame([(0, again), (1, shout), (2, periodic), (3, new(10) + " " + " ".join([short] * 3)), (4, None), (5, "a\n" * 500)], "doc_id long, text string")
    got = {r.doc_id: r for r in substring.substring_dedup(df).collect()}
    kept = again.split("\n")
    assert got[0].text.split() == " ".join([kept[0], kept[1], *kept[3:6]]).split() and got[0].removed_words == 120
    assert [got[i].removed_words for i in (1, 2, 4, 5)] == [0, 0, 0, 0]
    assert got[3].removed_words == 90  # an earlier text has it


def test_substring_with_clashing_names(spark):
    text = words(80)
    df = spark.createDataFrame([(1, text, 7, 8, "m", 80), (2, text, 7, 8, "m", 80)], "doc_id long, text string, removed_words int, Removed_Spans int, __marks string, n_chars int")
    got = {r.doc_id: r for r in substring.substring_dedup(df).collect()}
    assert got[1].removed_words == 0 and got[2].removed_words == 80 and got[2]["__marks"] == "m"
    out = substring.cleaned(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, text, 7, 8, "m", 80), (2, "", 7, 8, "m", 0)]


def slow_base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_fences(spark, docs, rows, empty):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_filter(docs).collect())
    want = []
    for i, t, *_ in rows:
        if i == 7:
            base = (12_000, 12_000 * 6, 0, 0, 0) if len(words(1)) == 6 else None
            base = (12_000, sum(map(len, t.split())), 0, 0, 0)
        else:
            base = slow_base(t)
        want.append((-1 if i is None else i, *base, base[0] < 20 or 100 * base[4] > 30 * base[0]))
    assert got == sorted(want)
    assert quality.quality_filter(empty).count() == 0
    junk = [(i, words(50, 60 * i) + " ###" * (30 if i % 100 == 0 else 0), "en", "a") for i in range(300)]
    kept = {r.doc_id: r.kept for r in quality.quality_filter(spark.createDataFrame(junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(k == (i % 100 != 0) for i, k in kept.items())


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<|im_end|>\n<|im_start|>user\nx", r"<\|im_end|> <\\|im_start|>", "<|im_end|", "|im_end|>", "", None, "é\n\n", "<", "<\\"]
    turns = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(nasty)] + [(2, 0, "a\nb<|nl|><|im_end|>", "t"), (2, None, None, "null turn first"), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (None, 0, "user", "x")]
    turns += [(3, k, "assistant", f"{k} " * 50) for k in range(500)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df)
    pieces = {}
    for r in formatted.collect():
        pieces.setdefault(r.conv_id, []).append(r)
    key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    digests = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in (1, 2, None, 3):
        own = sorted((t for t in turns if t[0] == conv), key=key)
        whole = "".join(p.piece for p in sorted(pieces[conv], key=lambda p: p.turn_no))
        reader = chat.Reader()
        assert [(r, t) for r, t, _ in reader.feed(whole)] == [(t[2] or "", t[3] or "") for t in own]
        reader.end()
        loss = "".join(chat.unescape(whole[p.text_at : p.text_at + p.text_chars]) for p in sorted(pieces[conv], key=lambda p: p.turn_no) if p.loss)
        assert loss == "".join(t[3] or "" for t in own if t[2] == "assistant")
        d = digests[conv]
        assert d.n_turns == len(own) and d.formatted_chars == len(whole) and d.loss_chars == len(loss) and d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert d.turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_toxicity_learns_subwords(spark, empty, no_labels, docs):
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(500)]
    texts = []
    for i in range(400):
        w = rng.choice(vocabulary, 60).tolist()
        if i % 4 == 0:
            w[int(rng.integers(0, 60))] = "zuqwo" + str(rng.choice(list("abcdefghij")))
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_table(df, labels).collect()}
    held = [r for r in got.values() if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    model = toxicity.train_toxicity(df, labels)
    clean, unseen = model.posteriors([" ".join(vocabulary[:50]), " ".join(vocabulary[:50]) + " zuqwoxx"])[:, 1]
    assert clean < 0.3 <= unseen
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity_table(docs, no_labels).collect())
    assert toxicity.toxicity_table(empty, labels).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_subword_windows_match_a_plain_sum():
    m = subword.Model(subword.Settings(window=3), np.random.default_rng(7).normal(0, 3, (1 << 17, 2)).astype(np.float32), np.array([0.1, -0.2]))
    m.table[:, 0] = 0
    texts = ["", "one", "Aa bb\tcc dd  ee", "x y"]
    got = m.logits(texts)

    def word(w):
        raw, at = subword.codes([w])
        s, e, _ = subword.words(raw, at)
        g = [b for _, bs in subword.grams(raw, s, e, m.settings) for b in bs]
        return sum(float(m.table[b, 1]) for b in g) / len(g)

    for t, z in zip(texts, got, strict=True):
        w = [word(x) for x in t.lower().split()]
        bags = [sum(w[i : i + 3]) / 3 for i in range(0, len(w), 3)]
        assert z[0] == pytest.approx(0.1) and z[1] == pytest.approx(-0.2 + (np.log(np.sum(np.exp(bags))) if bags else 0), abs=1e-4)


def test_mixing_meets_targets(spark, empty, no_labels, docs):
    rng = np.random.default_rng(8)
    kinds = [[f"{c}{i}" for i in range(200)] for c in "pqr"]
    df = spark.createDataFrame([(i, " ".join(rng.choice(kinds[i % 3], int(rng.integers(20, 200))))) for i in range(600)], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, i % 3) for i in range(0, 600, 2)] + [(None, 1), (3, None)], "doc_id long, domain int")
    got = mixing.mixed(df, labelled, ("p", "q", "r"), {"p": 0.6, "q": 0.3, "r": 0.1}).toPandas()
    total = got.n_tokens.sum()
    for d, share in (("p", 0.6), ("q", 0.3), ("r", 0.1)):
        assert (got.rate * got.n_tokens * got[f"p_{d}"]).sum() / total == pytest.approx(share, abs=2e-3)
    assert (got.rate >= 0).all() and abs(got.copies - got.rate).max() < 1
    out = mixing.mix_documents(df, labelled, domains=("p", "q", "r"), weights={"p": 0.6, "q": 0.3, "r": 0.1})
    assert out.columns == df.columns and out.count() == got.copies.sum()
    labels = mixing.domains_of(no_labels)
    assert mixing.mixed(docs, labels).count() == docs.count() and mixing.mixed(empty, labels).count() == 0
    assert mixing.mix_documents(docs, labels).columns == docs.columns


def plain_rates(a, target, steps=400_000):
    """Of the nonnegative rates whose totals meet the targets those nearest to 1, by projected gradient with a fixed step."""
    y, step = np.zeros(a.shape[1]), 1 / np.linalg.norm(a.T @ a, 2)
    for _ in range(steps):
        miss = np.maximum(1 - a @ y, 0) @ a - target
        if np.abs(miss).sum() < 1e-9 * target.sum():
            break
        y += step * miss
    return np.maximum(1 - a @ y, 0)


def test_mixing_equals_plain_projected_gradient(spark):
    rng = np.random.default_rng(13)
    n, p = rng.integers(0, 400, 80), rng.dirichlet([0.5, 0.5, 0.5], 80)
    members = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(80)], "doc_id long, n_tokens long, p array<double>").cache()
    weights = np.array([0.6, 0.3, 0.1])
    y, _, target = mixing.fit_rates(members, weights)
    a = p * n[:, None] / 1e6
    assert target == pytest.approx(weights * n.sum())
    assert mixing._rates(a, y) == pytest.approx(plain_rates(a, target / 1e6), abs=1e-4)
    rate, copies = mixing._copies(y, 11)
    got = {r.doc_id: r for r in members.select("doc_id", rate.alias("rate"), copies.alias("copies")).collect()}
    assert [got[i].rate for i in range(80)] == pytest.approx(mixing._rates(a, y), abs=1e-9)
    assert all(abs(r.rate - r.copies) < 1 for r in got.values())


def test_mixing_of_odd_rows(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(i, text("p" if i % 2 else "q")) for i in range(40)] + [(7, text("q")), (7, text("q")), (None, text("p")), (50, None), (51, " "), (52, text("p") + " x" * 5_000)]
    df = spark.createDataFrame([(i, t, 5, "z", 1, 2) for i, t in rows], "doc_id long, text string, n_tokens int, P string, __copies int, __id int")
    labelled = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(7, 1)], "doc_id long, domain int")
    out = mixing.mix_documents(df, labelled, ("q", "p"), {"q": 0.8, "p": 0.2})
    assert out.columns == df.columns
    copies = mixing.mixed(df, labelled, ("q", "p"), {"q": 0.8, "p": 0.2}).toPandas()
    assert len(copies) == len(rows) and copies.rate[copies.n_tokens == 0].eq(1).all()
    got = out.toPandas()
    assert got.n_tokens.eq(5).all() and got.P.eq("z").all() and got.doc_id.isna().sum() == 1
    assert len(got) == copies.copies[copies.doc_id.notna()].sum() + 1


def test_mixing_meets_the_target_of_a_rare_domain(spark, caplog):
    rng = np.random.default_rng(11)
    p = np.where(np.arange(3_000)[:, None] % 300 == 0, [0.02, 0.02, 0.96], [0.3, 0.699, 0.001]) + rng.uniform(-0.0005, 0.0005, (3_000, 3)) * [1, -1, 0]
    p[1::2] = p[1::2][:, [1, 0, 2]]
    p /= p.sum(1, keepdims=True)
    n = rng.integers(20, 500, 3_000)
    members = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(3_000)], "doc_id long, n_tokens long, p array<double>").cache()
    for weights in ([0.40, 0.55, 0.05], [0.65, 0.35, 0.0]):
        y, fitted, target = mixing.fit_rates(members, np.array(weights))
        a = p * n[:, None] / 1e6
        rates = mixing._rates(a, y)
        on = np.array(weights) > 0
        assert (rates >= 0).all() and (rates @ a * 1e6)[on] == pytest.approx(target[on], rel=1e-6) and fitted == pytest.approx(rates @ a * 1e6, rel=1e-9)
        assert target == pytest.approx(np.array(weights) * n.sum())
        assert rates.max() > 4 or weights[2] == 0  # what the rare domain needs
    assert not caplog.records
    _, fitted, target = mixing.fit_rates(members, np.array([0.98, 0.01, 0.01]))  # no document is that much of the first
    assert caplog.records and np.abs(fitted - target).sum() > 1_000
    with pytest.raises(RuntimeError, match="converged"):
        mixing.fit_rates(members, np.array([0.40, 0.55, 0.05]), most_steps=1)


def test_resampling_prefers_the_target(spark, empty, no_labels, docs):
    rng = np.random.default_rng(9)
    good, bad = [f"g{i}" for i in range(300)], [f"b{i}" for i in range(300)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(good if i % 3 else bad, 80))) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = resample.resample(df, labels).toPandas()
    assert got.selected.sum() == round(300 * sum(i % 3 > 0 for i in range(0, 300, 2)) / 150)
    assert got[got.doc_id % 3 > 0].selected.mean() > 0.95
    cut = sorted(got.gumbel_key, reverse=True)[int(got.selected.sum()) - 1]
    assert ((got.gumbel_key >= cut) == got.selected).all()
    assert resample.resample(docs, no_labels).filter("selected").count() == round(0.5 * docs.count())
    assert resample.resample(empty, labels).count() == 0


def plain_mix(x):
    for shift, factor in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D)):
        x = (x ^ x >> shift) * factor % (1 << 64)
    return x ^ x >> 33


def plain_features(text):
    """Hashed words and word pairs, by arithmetic on whole numbers."""
    one, two = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
    h = [plain_mix(sum((b + 1) * pow(one, i, 1 << 64) for i, b in enumerate(w.lower().encode())) % (1 << 64)) for w in WORD.findall(text or "")]
    h += [plain_mix((a * two + b) % (1 << 64)) for a, b in zip(h, h[1:])]
    return [(x >> 20) % resample.BUCKETS for x in h]


def test_resampling_equals_brute_force(spark):
    rng = np.random.default_rng(14)
    good, bad = [f"g{i}" for i in range(40)], [f"B{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(good + bad[:10] if i % 3 else bad + good[:10], int(rng.integers(0, 60))))) for i in range(60)] + [(7, "other text"), (None, "g1 g2"), (61, None), (62, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 60, 2)] + [(7, 1, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    target_ids = {i for i in range(0, 60, 2) if i % 3} | {7}
    raw, target = np.ones(resample.BUCKETS), np.ones(resample.BUCKETS)
    for i, t in rows:
        np.add.at(raw, plain_features(t), 1)
        if i in target_ids:
            np.add.at(target, plain_features(t), 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    got = resample.resample(df, labels, share=0.4).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_features, round(r.log_weight, 8) + 0.0) for r in got) == sorted((i is None, i or 0, len(plain_features(t)), round(float(ratio[plain_features(t)].sum()), 8) + 0.0) for i, t in rows)
    best = sorted(got, key=lambda r: -r.gumbel_key)[: round(0.4 * len(rows))]
    assert sorted(map(str, best)) == sorted(str(r) for r in got if r.selected)
    noise = np.array([r.gumbel_key - r.log_weight for r in got])
    assert len(set(noise.round(9))) == len(rows)  # each row has a draw of its own


def test_gumbel_draws_are_even():
    u = resample.draws(pa.array(range(200_000)), np.arange(200_000) * 7, 5)
    assert abs(np.histogram(u, 20, (0, 1))[0] / 10_000 - 1).max() < 0.05
    noise = -np.log(-np.log(u))
    assert noise.mean() == pytest.approx(0.5772, abs=0.02) and noise.var() == pytest.approx(np.pi**2 / 6, rel=0.03)


def test_resampling_counts_all_target_texts(spark):
    df = spark.range(21_000).selectExpr("id AS doc_id", "concat('w', id) AS text")
    got = resample.resample(df, df.selectExpr("doc_id", "1 AS quality", "0 AS toxic")).toPandas()
    assert len(got) == 21_000 and (got.log_weight == 0).all()  # the target is all there is


def test_features_of_a_batch_are_those_of_each_text():
    texts = ["a b c", "", "A b", "b c d e", " c"]
    raw, at = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    f, t = resample.features(raw, at, 1 << 14)
    for i, x in enumerate(texts):
        own, _ = resample.features(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]), 1 << 14)
        assert sorted(f[t == i]) == sorted(own) and len(own) == max(0, 2 * len(x.split()) - 1)
