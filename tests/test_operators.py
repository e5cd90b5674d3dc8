import json
import os
import signal

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens.__main__ import main
from actlens.functions import vectors as V
from actlens.functions.text import cell, file_slug, normalized, parameter_slug
from actlens.operators import batches, chunk, code, metrics, report
from actlens.operators.align import tokenizers
from actlens.operators.model import Model, Plain
from actlens.operators.train import AdamW, calibrate, reinit_dead, train, train_plain
from actlens.plans import entries, texts
from actlens.sources.stop import StopOnSignal
from actlens.sources.store import Store, StoreConfig, locate, split_shard_ids
from actlens.sources.types import numpy_type, spark_type
from actlens.streaming.loader import CountBatches, aligned_stream, document_stream, split_validation


def test_worked_metrics(spark):
    """Four positions, one latent gated in three of them."""
    a, b, c = {1: 2.0, 2: 0.0, 3: 4.0}, {1: 1.0, 2: 3.0, 3: 2.0}, {1: 1.0, 2: 1.0, 3: 1.0}
    rows = [(p, 0, 1, s, z, z) for s, of in enumerate((a, b, c)) for p, z in of.items()]
    codes = spark.createDataFrame(rows, code.CODES)
    counts = metrics.latent_counts(codes, latents=2)
    got = {r.latent: r for r in metrics.rates(counts, 4).collect()}
    r = got[0]
    assert (r.n_gate, r.gate_rate, r.n_alive0, r.n_alive1, r.firing0, r.firing1) == (3, 0.75, 2, 3, 0.5, 0.75)
    assert (r.n_all, r.both01, r.either01, r.mean0, r.mean1) == (2, 2, 3, 3.0, 2.0)
    assert r.agreement == pytest.approx(2 / 3)
    corr = {(x.i, x.j, x.latent): x["corr"] for x in metrics.correlations(counts).collect()}
    assert corr[0, 1, 0] == pytest.approx(-0.5) and corr[0, 1, 1] == 0
    assert got[1].n_gate == 0 and got[1].agreement == 0
    flags = {x.latent: x for x in metrics.regimes(metrics.rates(counts, 4)).collect()}
    assert flags[0].ambiguous and not flags[0].universal and flags[1].dead


def test_alive_needs_a_firing_stream(spark):
    """A latent that is gated but never active isn't alive."""
    rows = [(p, 0, 1, s, 1.0, 1.0) for p in range(4) for s in range(3)] + [(p, 1, 2, s, -1.0, 0.0) for p in range(4) for s in range(3)]
    rated = metrics.rates(metrics.latent_counts(spark.createDataFrame(rows, code.CODES), latents=3), 4)
    assert [r.latent for r in metrics.alive(rated).collect()] == [0]


def test_sums_of_vectors_equal_those_of_codes(spark):
    rng = np.random.default_rng(3)
    dims = (5, 4, 3)
    w = [rng.integers(-5, 6, (12, d)).astype(float) for d in dims]
    rows = [(i, *(rng.integers(-9, 10, d).astype(float).tolist() for d in dims)) for i in range(60)]
    df = spark.createDataFrame(rows, "pos_id long, x0 array<double>, x1 array<double>, x2 array<double>").repartition(3)
    a = metrics.vector_counts(df, latents=12, k=3, encoders=code.logits_by(weights=w))
    assert "hashpartitioning(pos_id" not in a._jdf.queryExecution().toString()
    b = metrics.latent_counts(code.shared_codes(df, k=3, latents=12, weights=w), latents=12)
    assert sorted(map(tuple, a.select(*sorted(a.columns)).collect())) == sorted(map(tuple, b.select(*sorted(a.columns)).collect()))


def test_top_k_keeps_the_lower_column():
    rng = np.random.default_rng(1)
    for k in (1, 3, 8, 9):
        x = rng.integers(0, 4, (50, 8)).astype(float)
        assert (code.top_k(x, k) == np.argsort(-x, axis=1, kind="stable")[:, :k]).all()


def test_vector_functions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "x array<double>, y array<double>").select(
        V.dot(F.col("x"), F.col("y")).alias("dot"), V.l2_norm(F.col("x")).alias("norm"), V.rms(F.col("x")).alias("rms"), V.nmse(F.col("y"), F.col("x")).alias("nmse"),
        V.l1_ratio(F.col("y"), F.col("x")).alias("l1"), V.unit_norm(F.col("x")).alias("unit"), V.tangent(F.col("x"), F.col("y")).alias("tangent"), V.scaled(F.col("x"), F.lit(2.0)).alias("scaled"),
    ).first()
    assert (row.dot, row.norm, row.nmse, row.l1) == (3.0, 5.0, pytest.approx(20 / 25), pytest.approx(0.2))
    assert row.rms == pytest.approx(12.5**0.5) and row.unit == pytest.approx([0.6, 0.8]) and row.tangent == [0.0, 4.0] and row.scaled == [6.0, 8.0]


def test_text_functions(spark):
    row = spark.createDataFrame([(" a/b c.1-x ", "ﬁle  ẞ", "x" * 40)], "name string, text string, long string").select(
        file_slug(F.col("name")).alias("file"), parameter_slug(F.trim("name")).alias("par"), normalized(F.col("text")).alias("norm"), cell(F.col("long")).alias("cell")
    ).first()
    assert (row.file, row.par, row.norm, row["cell"]) == ("a_b-c.1-x", "a_b c_1_x", "file ss", "x" * 29 + "...")


def brute_chunks(text, limit, count):
    out, cur, n = [], None, 0
    for p in [p.strip(" \t\r\n") for p in text.split("\n")]:
        if not p or count(p) > limit:
            continue
        k = count(p)
        if cur is None:
            cur, n = p, k
        elif n + 1 + k > limit:
            out.append((cur, n))
            cur, n = p, k
        else:
            cur, n = cur + "\n" + p, n + 1 + k
    return out + ([(cur, n)] if cur is not None else [])


def test_paragraph_chunks(spark):
    from actlens.operators.align import tokenizers

    count = lambda p: len(tokenizers([0])[0](p))
    texts = ["a b c\n\nd e\n" + "w " * 30 + "\n f g h i\nj", "", None, "one", "\n \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.doc_id, r.chunk_idx, r.chunk_text, r.n_tok) for r in chunk.paragraph_chunks(docs, 6).orderBy("doc_id", "chunk_idx").collect()]
    want = [(i, k, t, n) for i, x in enumerate(texts) for k, (t, n) in enumerate(brute_chunks(x or "", 6, count))]
    assert got == want


def test_offsets_equal_a_running_sum(spark):
    rows = [(i * 3, (i * 7) % 5) for i in range(200)]
    got = {r.doc_id: r.start for r in chunk.offsets(spark.createDataFrame(rows, "doc_id long, n long"), buckets=8).collect()}
    total = 0
    for i, n in rows:
        assert got[i] == total
        total += n


def test_token_windows_skip(spark):
    docs = spark.createDataFrame([(0, "a b c d"), (1, "e f"), (2, None)], "doc_id long, text string")
    seq = lambda skip: [(r.seq, r.pos, r.piece) for r in chunk.token_windows(docs, 3, skip).orderBy("seq", "pos").collect()]
    assert seq(0) == [(0, 0, "a"), (0, 1, " b"), (0, 2, " c"), (1, 0, " d"), (1, 1, "<eos>"), (1, 2, "e")]
    assert seq(2)[0] == (0, 0, " c")


def test_token_windows_of_repeated_ids(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "c d e"), (1, "f g h"), (1, "f g h"), (2, "i")], "doc_id long, text string")
    got = [r.piece.strip() for r in chunk.token_windows(docs, 2).orderBy("seq", "pos").collect()]
    assert got[:3] == ["a", "b", "<eos>"] and sorted(got) == sorted("a b <eos> c d e <eos> f g h <eos> f g h <eos> i".split())
    assert [r.piece for r in chunk.token_windows(docs.where("doc_id = 0"), 1, eos=None).orderBy("seq").collect()] == ["a", " b"]


def test_token_windows_bound_what_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(chunk, "PART", 2_000, raising=False)
    docs = spark.createDataFrame([(i * 5 - 300, f"w{i} " * 40) for i in range(400)] + [(None, "n")], "doc_id long, text string")
    got = chunk.token_windows(docs, 16).withColumn("task", F.spark_partition_id()).toPandas()
    held = got.groupby("task")["piece"].apply(lambda p: len("".join(p)))
    assert held.max() < 4 * 2_000  # of 70 KB
    want = ["n", "<eos>", *(p for i in range(400) for p in [*tokenizers([0])[0](f"w{i} " * 40), "<eos>"])]
    assert list(got.sort_values(["seq", "pos"])["piece"]) == want[: len(want) // 16 * 16]


def test_resumed_sequences_have_no_row_a_token(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunk, "PART", 3_000, raising=False)
    docs = [(i, f"v{i} " * (20 + 900 * (i == 7))) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = texts.token_sequences_resume(spark, str(tmp_path))
    assert "posexplode" not in rows._jdf.queryExecution().executedPlan().toString()
    want = [p for _, t in docs for p in [*tokenizers([0])[0](t), "<eos>"]][texts.SKIP :]
    cut = [want[i : i + texts.WINDOW] for i in range(0, len(want) // texts.WINDOW * texts.WINDOW, texts.WINDOW)]
    assert [tuple(r) for r in rows.orderBy("seq").collect()] == [(i, len(w), len("".join(w)), w[0]) for i, w in enumerate(cut)]


def test_store_forgets_what_a_broken_run_left(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.append(store_rows(spark, 4), 4)
    broken = store_rows(spark, 12, 900).withColumn("shard_index", (F.col("pos_id") / 4).cast("int") + 1)
    broken.write.mode("append").partitionBy("shard_index").parquet(f"{tmp_path}/s/shards")  # shards 1 to 3, never committed
    store.append(store_rows(spark, 4, 100), 4)
    assert store.committed() == (8, 2) and [r.last_tok_a for r in store.scan().orderBy("pos_id").collect()] == [0, 1, 2, 3, 100, 101, 102, 103]


def test_locate(spark):
    manifest = spark.createDataFrame([(0, 5), (1, 0), (2, 3), (3, 9)], "shard_index int, num_tokens long")
    idx = spark.createDataFrame([(i,) for i in range(17)], "idx long")
    got = {r.idx: (r.shard_index, r.local) for r in locate(idx, manifest).collect()}
    assert got == {i: (0, i) if i < 5 else (2, i - 5) if i < 8 else (3, i - 8) for i in range(17)}
    with pytest.raises(Exception, match="index out of range"):
        locate(idx.union(spark.createDataFrame([(17,)], "idx long")), manifest).collect()


def test_dead_counters(spark):
    rows = [(0, 0, 1, 0, 1.0, 1.0), (40, 0, 1, 0, 1.0, 1.0), (40, 1, 2, 0, 0.0, 0.0)]
    got = {(r.stream_idx, r.latent): r.last_non_zero for r in code.dead_counters(spark.createDataFrame(rows, code.CODES), 4, 32, 1e-3, latents=2).collect()}
    assert got[0, 0] == 3 and got[0, 1] == 4 and got[1, 0] == 4


def test_relational_gate_agrees():
    x = np.array([[1.0, 3.0, 3.0, 2.0]])
    assert code.top_k(x, 3).tolist() == [[1, 2, 3]]


def store_rows(spark, n, start=0):
    return spark.range(n).select(F.col("id").alias("pos_id"), (F.col("id") + start).cast("int").alias("last_tok_a"), F.array(F.col("id").cast("float")).alias("model_a"))


def test_store_round_trip(spark, tmp_path):
    config = StoreConfig(models=[{"name": "a", "slug": "a", "hidden_size": 1, "hook_point": "h"}], shard_size_tokens=4)
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.manifest().count() == 0 and store.committed() == (0, 0)
    store.write_config(config)
    assert store.write_config(config) == config
    with pytest.raises(ValueError):
        store.write_config(StoreConfig(shard_size_tokens=5))
    store.append(store_rows(spark, 10), 4)
    assert [(r.shard_index, r.token_start, r.token_end, r.num_tokens) for r in store.manifest().collect()] == [(0, 0, 4, 4), (1, 4, 8, 4), (2, 8, 10, 2)]
    store.append(store_rows(spark, 5, 100), 4)
    assert store.committed() == (15, 5)
    rows = store.scan(["a"]).orderBy("pos_id").collect()
    assert [r.pos_id for r in rows] == list(range(15)) and rows[10].last_tok_a == 100
    assert [r.pos_id for r in store.read_range(3, 6).orderBy("pos_id").collect()] == [3, 4, 5]
    assert store.scan(shards=[1]).count() == 4
    with pytest.raises(KeyError):
        store.scan(["b"])
    with pytest.raises(KeyError):
        StoreConfig.parse(json.dumps({"dtype": "float32"}))


def test_split_shard_ids():
    train_ids, valid = split_shard_ids(list(range(10)), 0.25)
    assert len(valid) == 3 and sorted(train_ids + valid) == list(range(10)) and split_shard_ids(list(range(10)), 0.25) == (train_ids, valid)
    with pytest.raises(ValueError):
        split_shard_ids([1], 0.5)


def test_stream_equals_batch(spark, tmp_path):
    texts = [f"alpha beta gamma{i}\nword number {i} is here" for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for k in range(3):
        docs.where(F.col("doc_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    sink = CountBatches(spark, f"{tmp_path}/out", 8)

    def go():
        rows = aligned_stream(document_stream(spark, f"{tmp_path}/in", 1), 16)
        rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)

    go()
    n = spark.read.parquet(f"{tmp_path}/out/rows").count()
    assert n == aligned_stream(docs, 16).count()
    docs.withColumn("doc_id", F.col("doc_id") + 100).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    go()  # goes on where it stopped
    rows = spark.read.parquet(f"{tmp_path}/out/rows")
    assert rows.count() == 2 * n and rows.select("pos_id").distinct().count() == 2 * n and rows.agg(F.max("pos_id")).first()[0] == 2 * n - 1
    first = rows.where("epoch = 0").drop("pos_id", "epoch")
    sink(spark.createDataFrame(first.collect(), first.schema), 0)  # a repeated micro-batch changes nothing
    assert spark.read.parquet(f"{tmp_path}/out/rows").count() == 2 * n
    batches = sink.batches()
    assert batches.count() == 2 * n // 8 * 8
    valid, rest = split_validation(batches, 9, 8)
    assert valid.count() == 16 and rest.count() == batches.count() - 16


@pytest.mark.parametrize("how", [{}, {"rank": 3}, {"auxk": 2, "dead_after": 5}, {"rank": 3, "auxk": 2, "dead_after": 5}])
def test_gradients(how):
    rng = np.random.default_rng(0)
    m = Model.create({"a": 5, "b": 4}, 7, 3, seed=1, **how)
    for n in m.streams:
        m.last_non_zero[n][[1, 4, 6]] = 9
        m.params[f"pre_bias.{n}"] += 0.1
    x = {"a": rng.standard_normal((6, 5)), "b": rng.standard_normal((6, 4))}
    given, whole = {}, m.auxiliary
    if m.auxk:  # its target is taken as given: it stays that of the unchanged weights
        scaled, _, z = m.encode(x)
        given = {n: whole(scaled[n], m.decode(z[n], n), n)[1] for n in m.streams}
        m.auxiliary = lambda scaled, recon, name: (whole(scaled, recon, name)[0], given[name])
    loss, grads, _ = m.loss_and_gradients(x)
    assert set(grads) == set(m.params)
    for key, g in grads.items():
        flat = m.params[key].reshape(-1)
        for i in rng.choice(flat.size, 4):
            old = flat[i]
            flat[i] = old + 1e-6
            up = m.loss_and_gradients(x)[0]
            flat[i] = old - 1e-6
            down = m.loss_and_gradients(x)[0]
            flat[i] = old
            assert (up - down) / 2e-6 == pytest.approx(g.reshape(-1)[i], rel=1e-3, abs=1e-5), key


def test_plain_gradients():
    rng = np.random.default_rng(0)
    m, x = Plain.create(4, 6, l1=0.5), rng.standard_normal((5, 4))
    total = lambda: (lambda s: s[0] + m.l1 * s[1])(m.loss_and_gradients(x)[0])
    for key, g in m.loss_and_gradients(x)[1].items():
        flat = m.params[key].reshape(-1)
        for i in rng.choice(flat.size, 4):
            old = flat[i]
            flat[i] = old + 1e-6
            up = total()
            flat[i] = old - 1e-6
            down = total()
            flat[i] = old
            assert (up - down) / 2e-6 == pytest.approx(g.reshape(-1)[i], rel=1e-3, abs=1e-5), key


def vectors_of(spark, n=40):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(i, rng.standard_normal(6).tolist(), rng.standard_normal(4).tolist()) for i in range(n)], "pos_id long, x0 array<double>, x1 array<double>")


def test_low_rank_training(spark, tmp_path):
    df = vectors_of(spark)
    m = Model.create({"a": 6, "b": 4}, 12, 4, rank=3, auxk=4, dead_after=2)
    losses = train(m, [df.where("pos_id < 20"), df.where("pos_id >= 20")], epochs=4, rate=0.02, reinit_every=3)
    assert losses[-1] < losses[0]
    m.save(spark, f"file://{tmp_path}/m")
    again = Model.load(spark, f"file://{tmp_path}/m", 4, auxk=4, dead_after=2)
    assert (again.rank, again.latents, again.streams) == (3, 12, m.streams) and all(np.array_equal(v, again.params[k]) for k, v in m.params.items())
    assert list(Model.load(spark, f"file://{tmp_path}/m", 4, ["b"]).streams) == ["b"]
    with pytest.raises(ValueError, match="no encoders"):
        Model.load(spark, f"file://{tmp_path}/m", 4, ["c"])


def test_plain_training(spark):
    df = vectors_of(spark)
    steps = train_plain(Plain.create(6, 8, l1=1e-3), [df.where("pos_id < 20"), df.where("pos_id < 0"), df.where("pos_id >= 20")], steps=9, rate=0.05)
    assert len(steps) == 9 and steps[-1][0] < steps[0][0]
    with pytest.raises(ValueError, match="no batch"):
        train_plain(Plain.create(6, 8), [df.where("pos_id < 0")], steps=1)


def test_training_lowers_the_loss(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).tolist(), rng.standard_normal(4).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "pos_id long, x0 array<double>, x1 array<double>")
    m = Model.create({"a": 6, "b": 4}, 12, 4)
    calibrate(m, df)
    assert all(v > 0 for v in m.scale.values())
    losses = train(m, [df.where("pos_id < 20"), df.where("pos_id >= 20")], epochs=6, rate=0.02)
    assert losses[-1] < losses[0]
    for n in m.streams:
        assert np.linalg.norm(m.params[f"decoder.{n}"], axis=0) == pytest.approx(np.ones(12), abs=1e-6)
    m.save(spark, f"file://{tmp_path}/m")
    again = Model.load(spark, f"file://{tmp_path}/m", 4)
    assert again.streams == m.streams and all(np.array_equal(v, again.params[k]) for k, v in m.params.items())


def test_reinit_and_names():
    m = Model.create({"a": 3}, 4, 2)
    m.last_non_zero["a"][:] = [0, 5, 11, 20]
    assert reinit_dead(m, 10, np.random.default_rng(0)) == 2 and m.last_non_zero["a"].tolist() == [0, 5, 0, 0]
    with pytest.raises(ValueError):
        Model.create({"a-b": 2, "a.b": 2}, 4, 2)
    p = {"w": np.ones(2)}
    AdamW(0.1, decay=0.0).step(p, {"w": np.array([1.0, -1.0])})
    assert p["w"] == pytest.approx([0.9, 1.1])


def test_reports_of_a_checkpoint(spark, tmp_path):
    df, m = vectors_of(spark), Model.create({"a": 6, "b": 4}, 12, 4, rank=3)
    calibrate(m, df)
    for n in m.streams:
        m.params[f"latent_bias.{n}"] += 0.2
    m.save(spark, f"file://{tmp_path}/m")
    got = report.report_checkpoint(spark, f"file://{tmp_path}/m", df, 4, f"file://{tmp_path}/r.json", ["b", "a"][::-1], max_positions=30)
    assert report.read_report(spark, f"file://{tmp_path}/r.json") == got
    rows = df.where("pos_id < 30").orderBy("pos_id").collect()
    x = {"a": np.array([r.x0 for r in rows]), "b": np.array([r.x1 for r in rows])}
    _, gate, z = m.encode(x)
    assert got["n_positions"] == 30 and got["gate_rate"] == pytest.approx(np.bincount(gate.reshape(-1), minlength=12) / 30)
    assert got["firing_rate_per_stream"][1] == pytest.approx((z["b"] > 0).mean(axis=0))
    both, either = ((z["a"] > 0) & (z["b"] > 0)).sum(), ((z["a"] > 0) | (z["b"] > 0)).sum()
    assert got["jaccard_per_pair"]["a|b"] == pytest.approx(both / either) and got["L0_mean"][0] == pytest.approx((z["a"] > 0).sum() / 30)
    shown = report.evaluate_checkpoint(spark, f"file://{tmp_path}/m", df, 4, f"file://{tmp_path}/e.json")
    whole = {"a": np.array([r.x0 for r in df.orderBy("pos_id").collect()]), "b": np.array([r.x1 for r in df.orderBy("pos_id").collect()])}
    z = m.encode(whole)[2]
    miss = ((m.decode(z["a"], "b") / m.scale["b"] - whole["b"]) ** 2).sum() / ((whole["b"] - whole["b"].mean(axis=0)) ** 2).sum()
    assert shown["cross_recon_b_from_a"]["fvu"] == pytest.approx(miss) and shown["recon_a"]["fve"] == pytest.approx(1 - shown["recon_a"]["fvu"])
    assert [v.split()[0] for v in report.lines(shown)] == ["SELF", "SELF", "CROSS", "CROSS"]


def test_report_without_positions(spark):
    got = report.universality(vectors_of(spark).where("pos_id < 0"), Model.create({"a": 6, "b": 4}, 12, 4))
    assert got["n_positions"] == 0 and got["regime_counts"]["dead"] == 12 and got["top_universal_idx"] == [] and set(got["agreement_rate_percentiles"].values()) == {0.0}


def test_types_and_padding():
    assert spark_type("bfloat16") == "float" and numpy_type("float16") is np.float16
    for f in (spark_type, numpy_type):
        with pytest.raises(ValueError):
            f("float8")
    assert batches.pad_arrays([[1, 2], [], [3]], 9).tolist() == [[1, 2], [9, 9], [3, 9]] and batches.pad_arrays([[]], 9).shape == (1, 0)
    assert [batches.filler(0, 5), batches.filler(None, 5), batches.filler(None)] == [0, 5, 0]


def test_padding_of_nulls(spark):
    rows = spark.createDataFrame([(0, [1, 2]), (0, None), (1, [])], "b int, t array<long>")
    assert sorted((r.b, r.width, r.t) for r in batches.pad_batches(rows, "b", "t", 7).collect()) == [(0, 2, [1, 2]), (0, 2, [7, 7]), (1, 0, [])]


def test_stop_on_signal():
    before = signal.getsignal(signal.SIGTERM)
    with StopOnSignal() as stop:
        os.kill(os.getpid(), signal.SIGTERM)
        assert stop.stop
    assert signal.getsignal(signal.SIGTERM) is before


def some_docs(spark, n=12):
    return spark.createDataFrame([(i, f"alpha beta gamma{i}\nword number {i} is here") for i in range(n)], "doc_id long, text string")


def test_run_goes_on_after_a_stop(spark, tmp_path):
    ids, vectors = lambda s, t: np.array([len(x) for x in t]), lambda s, t: np.array([[len(x), i + s] for i, x in enumerate(t)])
    config = entries.config_of(["a/x", "b"], [2, 2], ["h"], shard_size_tokens=8, token_dtype="int64")
    docs, root = some_docs(spark), f"file://{tmp_path}/s"

    class Once(StopOnSignal):  # asks to stop after the first step
        asked = 0

        @property
        def stop(self):
            self.asked += 1
            return self.asked > 1

        @stop.setter
        def stop(self, _):
            pass

    how = {"max_tokens": 16, "shards_a_step": 1, "streams": (0, 2)}
    assert entries.preprocess_aligned(spark, docs, root, config, vectors, ids, 30, stop=Once(), **how) == 8
    assert entries.preprocess_aligned(spark, docs, root, config, vectors, ids, 30, **how) == 30 == len(Store(spark, root))
    assert entries.preprocess_aligned(spark, docs, root, config, vectors, ids, 30, **how) == 30
    whole = f"file://{tmp_path}/w"
    entries.preprocess_aligned(spark, docs, whole, config, vectors, ids, 30, max_tokens=16, streams=(0, 2))
    read = lambda at: [tuple(r) for r in Store(spark, at).scan(["a/x", "b"]).drop("shard_index").orderBy("pos_id").collect()]
    assert read(root) == read(whole) and Store(spark, root).stream_dims() == {"a/x": 2, "b": 2}
    shared = f"file://{tmp_path}/t"
    assert entries.preprocess_shared(spark, docs, shared, config, vectors, ids, 50, length=8, shards_a_step=2) == 48


def test_loader_and_training_on_a_store(spark, tmp_path):
    rng = np.random.default_rng(0)
    store = Store(spark, f"file://{tmp_path}/s")
    store.write_config(StoreConfig(models=[{"name": n, "slug": n, "hidden_size": 3, "hook_point": "h"} for n in "ab"], shard_size_tokens=10))
    rows = spark.createDataFrame([(i, i, rng.standard_normal(3).tolist(), i + 100, rng.standard_normal(3).tolist()) for i in range(35)], "pos_id long, last_tok_a int, model_a array<float>, last_tok_b int, model_b array<float>")
    store.append(rows, 10)
    got = list(store.load(["a", "b"], 4, seed=1))
    seen = [b["tokens"]["a"].tolist() for b in got]
    assert len(got) == 2 + 2 + 2 + 1 and all(t == list(range(t[0], t[0] + 4)) for t in seen) and got[0]["activations"]["b"].shape == (4, 3)
    assert seen == [b["tokens"]["a"].tolist() for b in store.load(["a", "b"], 4, seed=1)] != sorted(seen)
    plain = [b["tokens"]["b"].tolist() for b in store.load(["b"], 4, shuffle=False, drop_last=False)]
    assert sum(plain, []) == list(range(100, 135))
    assert [sorted(r.pos_id for r in b.collect()) for b in store.training_batches(["a"], 4, seed=1)] == seen
    model, losses, held = entries.train_on_store(spark, store.root, f"file://{tmp_path}/m", 6, 2, batch=5, epochs=2, valid=0.3, rate=0.02)
    assert losses[1] < losses[0] and set(held) == {"recon_a", "recon_b", "cross_recon_a_from_b", "cross_recon_b_from_a"}
    assert Model.load(spark, f"file://{tmp_path}/m", 2).streams == {"a": 3, "b": 3}


def test_stream_length(spark, tmp_path):
    with pytest.raises(TypeError):
        len(CountBatches(spark, f"{tmp_path}/x", 4))
    sink = CountBatches(spark, f"{tmp_path}/x", 4, steps_per_epoch=2)
    rows = spark.range(26).select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("chunk_idx"), F.col("id").cast("int").alias("k"))
    sink(rows, 0)
    assert len(sink) == 2 and sorted(r.pos_id for r in sink.epoch(1, first_batch=1).collect()) == list(range(12, 20))


MODELS = (lambda s, t: np.array([[len(x), i + s] for i, x in enumerate(t)]), lambda s, t: np.array([len(x) for x in t]))


def test_command_line(spark, tmp_path, capsys):
    some_docs(spark, 30).write.parquet(f"{tmp_path}/docs")
    where, models = f"file://{tmp_path}", f"{__name__}:MODELS"
    common = ["--documents", f"{where}/docs", "--model-names", "a", "b", "--hidden-sizes", "2", "2", "--hook-points", "h", "--models", models, "--target", "60", "--shard-size", "16"]
    main(["aligned", "--store", f"{where}/s", "--length", "16", *common], spark)
    main(["shared", "--store", f"{where}/t", "--length", "10", *common], spark)
    main(["train", "--store", f"{where}/s", "--checkpoint", f"{where}/m", "--latents", "6", "--k", "2", "--batch", "8", "--valid", "0.3", "--auxk", "2"], spark)
    for run in ("evaluate", "report"):
        main([run, "--store", f"{where}/s", "--checkpoint", f"{where}/m", "--k", "2", "--output", f"{where}/{run}.json", "--positions", "40"], spark)
    out = capsys.readouterr().out
    assert out.count("positions in the store: 60") == 2 and "SELF  recon_a" in out and "n_positions: 40" in out
    assert json.loads((tmp_path / "report.json").read_text())["regime_counts"].keys() == {"universal", "stream_specific", "dead", "ambiguous"}
