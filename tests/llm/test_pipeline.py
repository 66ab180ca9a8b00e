"""The pipeline stage by stage against plain versions, on a small corpus with planted cases."""

import itertools

import numpy as np
import pytest

from tessera.llm import bpe, mixing, simhash, toxicity

from test_text_operators import plain_rates, slow_fingerprint, slow_left


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(20)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(900)]
    new = lambda n: " ".join(rng.choice(vocabulary, n))
    passage = new(70)
    rows = [(i, new(int(rng.integers(60, 160)))) for i in range(160)]
    for i in range(0, 160, 4):  # toxic ones
        w = rows[i][1].split()
        for _ in range(4):
            w[int(rng.integers(0, len(w)))] = "zuqwo" + str(rng.choice(list("abcdefghij")))
        rows[i] = (i, " ".join(w))
    rows += [(200 + i, rows[5][1]) for i in range(12)]  # copies
    rows += [(230 + i, new(60) + " " + passage + "\n" + new(60)) for i in range(6)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, new(3)), (304, new(9_000)), (305, "same " * 300), (None, new(80)), (7, rows[7][1]), (7, new(100))]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1.5, "x", 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, removed_words string, __copies int, p int")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_stages_against_plain_versions(spark, corpus, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    columns, seen = docs.columns, [rows_of(docs)]
    for name, fn in corpus_pipeline.STAGES:
        out = fn(spark, docs, corpus)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "byte_bpe":
            assert docs.columns == columns
        seen.append(rows_of(docs))
        if name == "mixing":
            mixed_from = before
    model = toxicity.train_toxicity(spark.read.parquet(f"{corpus}/documents.parquet"), labels)
    score = model.posteriors([t or "" for _, t in seen[0]])[:, 1]
    assert seen[1] == [r for r, p in zip(seen[0], score, strict=True) if p < toxicity.THRESHOLD]
    toxic, clean = [r for r in seen[0] if r[0] is not None and r[0] < 160 and r[0] % 4 == 0], [r for r in seen[0] if r not in seen[1] and (r[0] is None or r[0] >= 160 or r[0] % 4)]
    assert sum(r not in seen[1] for r in toxic) >= 0.95 * len(toxic) and len(clean) <= 2
    # one row of each component
    fps = [slow_fingerprint(t) for _, t in seen[1]]
    label = list(range(len(fps)))
    near = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    for _ in range(10):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    groups = {}
    for r, g in zip(seen[1], label, strict=True):
        groups.setdefault(g, []).append(r)
    for g in groups.values():
        named = [r for r in g if r[0] is not None]
        least = min((r[0] for r in named), default=None)
        kept = [r for r in seen[2] if r in g]
        assert len([r for r in kept if r[0] is not None]) == (1 if named else 0) and all(r[0] in (least, None) for r in kept)
    assert len(seen[2]) == sum(len([r for r in g if r[0] is None]) + any(r[0] is not None for r in g) for g in groups.values())
    # repeated passages
    ranked = [r for r in seen[2] if r[0] is not None]
    left = slow_left([t or "" for _, t in sorted(ranked, key=lambda r: r[0])])
    got = {(i, tuple((t or "").split())) for i, t in seen[3] if i is not None and i != 7}
    assert got == {(r[0], tuple(w)) for r, w in zip(sorted(ranked, key=lambda r: r[0]), left, strict=True) if r[0] != 7}
    # the mix
    members = mixing.memberships(mixed_from, mixing.train_domains(mixed_from, mixing.domains_of(labels), 3)).toPandas()
    a = np.stack(members.p) * members.n_tokens.to_numpy()[:, None] / 1e6
    weights = np.array([mixing.WEIGHTS["low"], mixing.WEIGHTS["high"]])
    rate = plain_rates(a[:, :2], weights / weights.sum() * a.sum())
    many = {}
    for i, t in seen[4]:
        many[i, t] = many.get((i, t), 0) + 1
    texts = members.text.where(members.text.notna(), None)
    assert all(abs(many.get((None if i != i else int(i), t), 0) - r) < 1 + 1e-3 for i, t, r in zip(members.doc_id, texts, rate, strict=True) if i == i)
    # token ids
    library = bpe.codec(bpe.rank_file()).library
    assert "token_ids" in docs.columns and seen[5] == seen[4]
    assert all(r.token_ids == library.encode_ordinary(r.text or "") for r in docs.collect())


def test_run_equals_its_stages(spark, corpus):
    import corpus_pipeline

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, fn in corpus_pipeline.STAGES:
        docs = simhash.settle(fn(spark, docs, corpus), "stage")
    got = corpus_pipeline.run(spark, corpus)
    assert got.columns == docs.columns and rows_of(got) == rows_of(docs)


def test_run_on_empty_tables(spark, corpus, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
