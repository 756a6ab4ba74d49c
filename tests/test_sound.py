"""Files of samples, change of rate, cepstra and recurrent layers against plain loops, whatever the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.operators import audio, recurrent
from lattiq.sources import text


def signal(spark, x, span):
    return spark.createDataFrame([(u, k // span, v[k : k + span].tolist()) for u, v in x.items() for k in range(0, len(v), span)], "utt string, block long, x array<double>")


def joined(rows, at):
    out = {}
    for r in sorted(rows, key=lambda r: r[at]):
        out.setdefault(r.utt, []).append((r[at], r.x))
    return out


def test_files_of_samples(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = {f"f{k}.wav": np.round(rng.normal(size=n) * 1000) for k, n in enumerate((0, 5, 2500))}
    for name, v in x.items():
        (tmp_path / name).write_bytes(audio.wave_bytes(v, 8000))
    listed = text.files(spark, str(tmp_path), ".wav")
    assert sorted((r["name"], r["bytes"]) for r in listed.collect()) == [(n, 44 + 2 * len(v)) for n, v in sorted(x.items())]
    got = audio.read_waves(spark.read.format("binaryFile").load(str(tmp_path)), span=1000).collect()
    assert {r.rate for r in got} == {8000} and len(got) == 4
    for name, v in x.items():
        assert np.array_equal(np.concatenate([r.x for r in sorted(got, key=lambda r: r.block) if r.utt.endswith(name)] or [[]]), v)
    with pytest.raises(ValueError):
        audio.wave(b"no sound at all")


@pytest.mark.parametrize("up,down,span", [(1, 2, 50), (3, 2, 64), (160, 147, 1000), (2, 4, 37)])
def test_rates_against_a_plain_convolution(spark, up, down, span):
    rng = np.random.default_rng(2)
    x = {"a": rng.normal(size=333), "b": rng.normal(size=1), "c": np.ones(400)}
    common = np.gcd(up, down)
    p, q = up // common, down // common
    h = audio.low_pass(p, q, 6)
    half = len(h) // 2
    got = joined(audio.resample(signal(spark, x, span), up, down, half=6, span=span).collect(), "at")
    for u, v in x.items():
        wide = np.zeros(len(v) * p)
        wide[::p] = v
        want = np.convolve(wide, h)[half : half + len(wide)][::q]
        places = np.cumsum([0] + [len(y) for _, y in got[u]])[:-1].tolist()
        assert [a for a, _ in got[u]] == places and np.allclose(np.concatenate([y for _, y in got[u]]), want)
    back = audio.in_blocks(audio.resample(signal(spark, x, span), up, down, half=6, span=span), 7)
    assert all(len(r.x) == 7 for r in back.join(back.groupBy("utt").agg(F.max("block").alias("top")), "utt").where("block < top").collect())
    assert np.allclose(np.concatenate([r.x for r in back.where("utt = 'a'").orderBy("block").collect()]), np.concatenate([y for _, y in got["a"]]))


@pytest.mark.parametrize("span", [200, 333, 5000])
def test_cepstra_in_blocks(spark, span):
    rng = np.random.default_rng(3)
    front = audio.FrontEnd()
    x = {"a": rng.normal(size=2000), "b": rng.normal(size=200), "c": rng.normal(size=199)}
    got = {(r.utt, r.t): r.x for r in audio.cepstra(signal(spark, x, span), front, span=span).collect()}
    want = {(u, t): front.features(v[None, t * 80 : t * 80 + 200])[0] for u, v in x.items() for t in range(max(0, (len(v) - 200) // 80 + 1))}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("rows", [3, 10, 8192])
def test_recurrent_layer_against_a_plain_loop(spark, rows):
    rng = np.random.default_rng(4)
    layer = recurrent.Lstm(rng.normal(size=(12, 2)), rng.normal(size=(12, 3)), rng.normal(size=12))
    x = {k: rng.normal(size=(n, 2)) for k, n in enumerate((1, 7, 25, 4, 3))}
    want = {}
    for k, v in x.items():
        h, c = np.zeros(3), np.zeros(3)
        for t, f in enumerate(v):
            i, g, m, o = (layer.w @ f + layer.u @ h + layer.b).reshape(4, 3)
            c = c / (1 + np.exp(-g)) + np.tanh(m) / (1 + np.exp(-i))
            h = np.tanh(c) / (1 + np.exp(-o))
            want[k, t] = h
    df = spark.createDataFrame([(k, t, f.tolist()) for k, v in x.items() for t, f in enumerate(v)], "utt int, t int, x array<double>").repartition(3)
    got = {(r.utt, r.t): r.h for r in recurrent.recurrent(df, layer, rows=rows).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert recurrent.recurrent(df.limit(0), layer).collect() == []
    with pytest.raises(ValueError):
        recurrent.Lstm(layer.w, layer.u[:11], layer.b)
