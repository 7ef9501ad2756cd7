"""The registered queries of operators that no SQL expresses, whole and column by column, against brute force."""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from corpusloom.llm import audio_media as am
from corpusloom.llm import queries
from test_simhash import brute_components, brute_fingerprint


def texts(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def test_op1(spark, small, tokenizer_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in queries.op1_sentencepiece(spark, small).collect()}
    held = texts(spark, small)
    assert set(rows) == set(held)
    for d, t in held.items():
        ids = [model.bos_id(), *model.encode(t), model.eos_id()]
        assert rows[d].n_tokens == len(ids) and rows[d].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert rows[d].decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def plain_log_mel(payload: bytes, c: am.AudioConfig) -> np.ndarray:
    """Filterbanks of the definition: each output sample, Fourier coefficient and triangle on its own."""
    x = [(b - 128) / 128 for b in payload]
    weights = am._phases(c.up, c.down, c.taps)
    y = []
    for n in range(len(x) * c.up // c.down):
        base, phase = n * c.down // c.up, n * c.down % c.up
        y.append(sum(float(weights[phase][j]) * x[i] for j in range(2 * c.taps) if 0 <= (i := base - c.taps + 1 + j) < len(x)))
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(20.0), mel(c.out_rate / 2), c.mels + 2)]
    rows = []
    for f in range(max(1, 1 + (len(y) - c.window) // c.hop)):
        frame = np.zeros(c.window)
        part = y[f * c.hop : f * c.hop + c.window]
        frame[: len(part)] = part
        frame *= [0.5 - 0.5 * np.cos(2 * np.pi * k / (c.window - 1)) for k in range(c.window)]
        k = np.arange(c.window)
        power = [abs(np.sum(frame * np.exp(-2j * np.pi * b * k / c.fft))) ** 2 for b in range(c.fft // 2 + 1)]
        row = []
        for low, mid, high in zip(edges[:-2], edges[1:-1], edges[2:], strict=True):
            total = 0.0
            for b, p in enumerate(power):
                hz = b * c.out_rate / c.fft
                total += p * max(0.0, min((hz - low) / (mid - low), (high - hz) / (high - mid)))
            row.append(np.log(total + 1e-6))
        rows.append(row)
    return np.array(rows)


def test_log_mel_against_the_definition():
    c = am.AudioConfig()
    payload = b"Some text with a few words, twice. " * 33
    payload += b"\xff" * (-len(payload) % 576)
    want = plain_log_mel(payload, c)
    got = np.concatenate([b for b, _ in am.frame_blocks(payload, c)])
    assert got.shape == want.shape and np.abs(got - want).max() < 2e-2
    raw, _ = am.tensor_stream([got], c)
    held = pa.ipc.open_stream(raw).read_all()["log_mel"].combine_chunks().to_numpy_ndarray().reshape(-1, c.mels)
    assert np.allclose(held[: len(got)], got) and np.allclose(held[len(got) :], np.log(1e-6))


def test_op2(spark, small):
    c = am.AudioConfig()
    rows = {r.doc_id: r for r in queries.op2_audio(spark, small).collect()}
    held, same = texts(spark, small), {}
    assert set(rows) == set(held)
    for n, (d, t) in enumerate(held.items()):
        own, r = t.encode(), rows[d]
        payload = own + b"\xff" * (-len(own) % 576 or (0 if own else 576))
        media = am.wav(payload, c.rate)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(own), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
        assert same.setdefault(t, r.feature) == r.feature
        if n % 20 == 0:
            mels, energies = zip(*am.frame_blocks(payload, c), strict=True)
            raw, windows = am.tensor_stream(list(mels), c)
            kind, frames, parts, digest, spans = r.feature.split("|")
            assert (kind, int(frames), int(parts), digest) == ("wav8", sum(map(len, energies)), windows, hashlib.sha256(raw).hexdigest())
            assert len([s for s in spans.split(",") if s]) == len(am.hysteresis(np.concatenate(energies), c)) == r.n_segments


def test_op10(spark, small):
    rows = {r.doc_id: r for r in queries.op10_simhash(spark, small).collect()}
    held = texts(spark, small)
    value = {d: brute_fingerprint(t) for d, t in held.items()}
    assert {d: r.fingerprint for d, r in rows.items()} == {d: f"{v % 2**64:016x}" for d, v in value.items()}
    root = brute_components(sorted(set(value.values())), 3)
    low = {}
    for d, v in value.items():
        low[root[v]] = min(d, low.get(root[v], d))
    assert {d: r.component_id for d, r in rows.items()} == {d: low[root[v]] for d, v in value.items()}
