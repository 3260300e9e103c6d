import hashlib
import zlib

import numpy as np
import pyarrow as pa

from octaspark.llm import media
from tests.llm.conftest import ODD


def test_payload_round_trip(make_docs):
    docs = make_docs(ODD, extra=["feature", "media"])
    got = {r.doc_id: r for r in media.digest_documents(docs).collect()}
    stored = {r.doc_id: bytes(r.media) for r in media.store(docs).collect()}
    for i, t in ODD:
        data = (t or "").encode()
        padded = data + b"\0" * ((-len(data)) % 64 or (0 if data else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        assert media.from_wav(stored[i]) == (padded, media.RATE)
        assert (r.media_bytes, r.media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
    assert got[6].feature == got[7].feature
    assert media.digest_documents(docs.limit(0)).count() == 0




def test_resampling_keeps_a_tone():
    for up, down in ((1, 2), (2, 3), (3, 2), (1, 1)):
        t = np.arange(4000) / 16000
        y = media.resample(np.sin(2 * np.pi * 500 * t).astype(np.float32), up, down)
        rate = 16000 * up / down
        spectrum = np.abs(np.fft.rfft(y[100:-100] * np.hanning(len(y) - 200)))
        assert len(y) == -(-4000 * up // down)
        assert abs(np.argmax(spectrum) * rate / (len(y) - 200) - 500) < rate / 1000
        assert 0.9 < np.abs(y[200:-200]).max() < 1.1


def test_resampling_equals_the_plain_filter():
    """Zeros between samples, one long filter over all, then every so many outputs: the phases give the same."""
    x = np.random.default_rng(3).normal(size=300).astype(np.float32)
    taps = media.TAPS
    for up, down in ((media.UP, media.DOWN), (3, 2), (1, 2), (5, 7)):
        n = np.arange(up * taps) - (up * taps - 1) / 2
        cut = 1 / max(up, down)
        h = np.sinc(n * cut) * cut * np.hamming(len(n)) * up
        spread = {up * k: float(v) for k, v in enumerate(x)}
        want = [sum(h[q] * spread.get(i * down + up * (taps // 2 - 1) - q, 0.0) for q in range(len(h))) for i in range(-(-len(x) * up // down))]
        np.testing.assert_allclose(media.resample(x, up, down), want, atol=1e-5)
    rows = media.phases(media.UP, media.DOWN, taps)
    assert len(rows) == media.UP > 1 and not np.allclose(rows[0], rows[1])


def test_log_mel_equals_plain_loops(monkeypatch):
    rate, frame, hop = 8000, media.FRAME, media.HOP
    x = np.random.default_rng(4).normal(size=2 * frame + 3 * hop + 17).astype(np.float32)
    mel_of, hz_of = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = [hz_of(mel_of(20) + k * (mel_of(rate / 2) - mel_of(20)) / (media.MELS + 1)) for k in range(media.MELS + 2)]
    frames = 1 + -(-(len(x) - frame) // hop)
    padded = np.concatenate([x, np.zeros((frames - 1) * hop + frame - len(x))])
    turn = np.exp(-2j * np.pi * np.outer(np.arange(frame // 2 + 1), np.arange(frame)) / frame)
    want = np.zeros((frames, media.MELS))
    for k in range(frames):
        part = padded[k * hop : k * hop + frame]
        power = np.abs(turn @ (part * np.hanning(frame))) ** 2
        for m in range(media.MELS):
            low, top, high = edges[m : m + 3]
            for i, p in enumerate(power):
                f = i * rate / frame
                want[k, m] += p * max(0.0, min((f - low) / (top - low), (high - f) / (high - top)))
    for block in (media.BLOCK_FRAMES, 2):
        monkeypatch.setattr(media, "BLOCK_FRAMES", block)
        mel, power = media.log_mel(x, rate)
        np.testing.assert_allclose(mel, np.log(want + 1e-8), rtol=1e-3, atol=1e-3)
        np.testing.assert_allclose(power, [np.mean(padded[k * hop : k * hop + frame] ** 2) for k in range(frames)], rtol=1e-4)


def test_hysteresis():
    e = np.array([0, 5, 3, 3, 1, 3, 9, 2, 2, 0, 3])
    assert media.hysteresis(e, 2, 4) == [(1, 4), (6, 9)]
    assert media.hysteresis(np.zeros(0), 2, 4) == []


def test_tensors(make_docs):
    x = media.extract(media.store(make_docs([(1, "some text " * 900), (2, None)]))).orderBy("doc_id").collect()
    batch = media.read_tensors(bytes(x[0].tensors))
    assert isinstance(batch.column(0), pa.FixedShapeTensorArray)
    shape = batch.column(0).to_numpy_ndarray().shape
    assert shape[1:] == (media.TENSOR_FRAMES, media.MELS)
    frames = 1 + -(-(9024 * media.UP // media.DOWN - media.FRAME) // media.HOP)
    assert shape[0] == -(-frames // media.TENSOR_FRAMES)
    starts, ends = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    assert (ends > starts).all() and starts[0] == 0
    assert len(x[1].segments) == 0
    assert media.extract(media.store(make_docs([(1, "a")])).selectExpr("doc_id", "cast(null AS binary) AS media")).first().tensors is None
