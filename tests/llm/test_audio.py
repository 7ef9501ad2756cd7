import hashlib

import numpy as np
import pyarrow as pa
from corpusloom.llm import audio_media as am

C = am.AudioConfig()


def test_payload_comes_back(awkward, empty):
    rows = am.audio_features(am.encode_media(awkward)).collect()
    assert len(rows) == 11
    sources = {r.doc_id: (r.text or "").encode() for r in awkward.collect() if r.doc_id is not None}
    for r in rows:
        assert len(r.payload) % 576 == 0 and len(r.payload) >= 576 and r.n_bytes <= len(r.payload)
        if r.doc_id is not None:
            own = sources[r.doc_id]
            assert bytes(r.payload) == own + b"\xff" * (len(r.payload) - len(own))
            assert len(r.payload) == max(576, -(-len(own) // 576) * 576)
    same = [hashlib.sha256(r.features).hexdigest() for r in rows if r.doc_id == 1]
    assert len(same) == 2 and len(set(same)) == 1
    assert am.audio_features(am.encode_media(empty)).count() == 0


def test_broken_media_gives_nulls(spark):
    media = spark.createDataFrame([(1, b"RIFF"), (2, None)], "doc_id long, media binary")
    assert all(r.payload is None and r.features is None for r in am.audio_features(media).collect())


def test_resampling_is_the_weighted_sum():
    x = np.random.default_rng(0).integers(0, 256, 700, dtype=np.uint8)
    n = am.resampled_length(len(x), C.up, C.down)
    got = am.resample(x, C.up, C.down, C.taps, 0, n)
    s = (x.astype(float) - 128) / 128
    weights = am._phases(C.up, C.down, C.taps).astype(float)
    for k in range(0, n, 37):
        base, phase = divmod(k * C.down, C.up)
        want = sum(weights[phase][j] * s[i] for j in range(2 * C.taps) if 0 <= (i := base - C.taps + 1 + j) < len(s))
        assert abs(got[k] - want) < 1e-5
    parts = np.concatenate([am.resample(x, C.up, C.down, C.taps, a, min(a + 50, n)) for a in range(0, n, 50)])
    assert np.allclose(parts, got, atol=1e-6)


def test_a_tone_keeps_its_frequency():
    t = np.arange(16_000)
    x = (128 + 100 * np.sin(2 * np.pi * 1000 * t / 16_000)).astype(np.uint8)
    y = am.resample(x, C.up, C.down, C.taps, 0, 12_000)
    assert abs(np.argmax(np.abs(np.fft.rfft(y))) - 1000) <= 1


def test_blocks_do_not_change_features():
    samples = np.random.default_rng(1).integers(0, 256, 576 * 60, dtype=np.uint8).tobytes()
    whole = [np.concatenate(x) for x in zip(*am.frame_blocks(samples, C), strict=True)]
    small = [np.concatenate(x) for x in zip(*am.frame_blocks(samples, am.AudioConfig(block_frames=7)), strict=True)]
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(whole, small, strict=True))


def test_hysteresis_against_a_loop():
    rng = np.random.default_rng(2)
    for _ in range(30):
        e = rng.uniform(0, 8, 60)
        on, start, want = False, 0, []
        for i, v in enumerate([*e, -99]):
            if not on and i < 60 and v >= e.min() + C.rise:
                on, start = True, i
            elif on and v < e.min() + C.fall:
                on = False
                want += [(start, i)] if i - start >= C.least_frames else []
        assert am.hysteresis(e, C) == want


def test_tensor_shape_and_spans():
    samples = bytes(range(256)) * 90
    blocks = [b for b, _ in am.frame_blocks(samples, C)]
    raw, n = am.tensor_stream(blocks, C)
    table = pa.ipc.open_stream(raw).read_all()
    column = table["log_mel"].combine_chunks()
    assert column.type.shape == [C.tensor_frames, C.mels] and len(column) == n
    assert np.allclose(column.to_numpy_ndarray().reshape(-1, C.mels)[: len(blocks[0])], np.concatenate(blocks)[: len(blocks[0])])
    ends, starts = table["end_s"].to_pylist(), table["start_s"].to_pylist()
    assert starts == sorted(starts) and all(a < b for a, b in zip(starts, ends, strict=True))
