"""The WebP codec by exact round trips; fitted models by held-out figures; media and main text against plain readings."""

import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import pytest

from sparloom.llm import media, webp
from sparloom.llm import queries as q

SF = "/root/testdata/sf0.001"


def table(name, cols, sf=SF):
    return duckdb.connect().sql(f"select {cols} from read_parquet('{sf}/{name}.parquet')").fetchall()


@pytest.mark.parametrize("seed", range(25))
def test_webp_tools(seed):
    rng = np.random.default_rng(seed)
    h, w = (int(x) for x in rng.integers(1, 23, 2))
    palette = rng.integers(0, 2**32, int(rng.choice([1, 2, 3, 5, 16, 17, 100, 256])), dtype=np.uint64).astype(np.uint32)
    pixels = palette[rng.integers(0, len(palette), (h, w))]
    th, tw = -(-h >> 2), -(-w >> 2)
    modes = rng.integers(0, 14, (th, tw)).astype(np.uint32) << 8
    cross = rng.integers(0, 2**24, (th, tw)).astype(np.uint32) | np.uint32(0xFF000000)
    for how in (
        {},
        {"cache_bits": int(rng.integers(1, 12))},
        {"references": True},
        {"references": True, "cache_bits": 4},
        {"transforms": (webp.PALETTE,), "references": bool(seed % 2)},
        {"transforms": (webp.PREDICTOR,), "modes": modes},
        {"transforms": (webp.CROSS,), "cross": cross},
        {"transforms": (webp.SUBTRACT_GREEN,)},
        {"transforms": (webp.PREDICTOR, webp.CROSS, webp.SUBTRACT_GREEN), "modes": modes, "cross": cross, "references": True, "cache_bits": 3},
        {"tiles": rng.integers(0, 3, (th, tw)), "references": True, "cache_bits": 2},
    ):
        stream = webp.write_image(pixels, **how)
        assert (webp.read_image(stream) == pixels).all(), how
        assert webp.unwrap(webp.wrap(stream) * 2) == [stream, stream]


def test_broken_streams_are_refused():
    stream = webp.write_image(np.arange(64, dtype=np.uint32).reshape(8, 8))
    for bad in (b"\0" + stream[1:], stream[: len(stream) // 2], stream[:3]):
        with pytest.raises((ValueError, IndexError)):
            webp.read_image(bad)
    with pytest.raises(ValueError):
        webp.unwrap(b"JUNK" + webp.wrap(stream)[4:])


def test_predictors_by_hand():
    left, top, corner, right = [10, 20, 30, 255], [14, 10, 40, 255], [12, 16, 36, 255], [0, 0, 0, 255]
    want = {0: [0, 0, 0, 255], 1: left, 2: top, 3: right, 4: corner, 5: [9, 10, 27, 255], 6: [11, 18, 33, 255], 7: [12, 15, 35, 255], 8: [13, 13, 38, 255], 9: [7, 5, 20, 255], 10: [9, 11, 26, 255], 12: [12, 14, 34, 255], 13: [12, 15, 35, 255]}
    for mode, value in want.items():
        assert webp.predict(mode, left, top, corner, right) == value, mode
    assert webp.predict(11, left, top, corner, right) in (left, top)


def test_near_distances():
    assert len(webp.NEAR) == 120 and webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-1] == (8, 7)


def test_array_reading_agrees_with_the_general_one():
    texts = [b"", b"a" * 64, bytes(range(256)) * 3, "é\U0001f600 text".encode() * 40, b"x" * 300_000, bytes(range(256)) * 400]
    stored = media.encode(texts)
    for text, m, images in zip(texts, stored, media.decode(stored)):
        assert media.samples(images) == text + bytes(64 if not text else -len(text) % 64)
        for stream, pixels in zip(webp.unwrap(m), images):
            assert (webp.read_image(stream) == pixels).all()


def test_media_query(spark):
    got = {r.doc_id: r for r in q.op6_webp_media(spark, SF).collect()}
    for doc, text in table("documents", "doc_id, text"):
        data = (text or "").encode()
        payload = data + bytes(64 if not data else -len(data) % 64)
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_main_text_query(spark):
    got = {r.page_id: r for r in q.op7_html_text(spark, SF).collect()}
    pages = table("pages", "page_id, url, html")
    right = 0
    for page, url, source in pages:
        article = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b.replace("<b>", "").replace("</b>", ""))).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", article)]
        right += got[page].text == "\n".join(b for b in blocks if b)
        assert got[page].url == url and got[page].n_chars == len(got[page].text)
    assert right >= 0.97 * len(pages)


def test_language_query_on_held_out_documents(spark):
    lang = dict(table("documents", "doc_id, lang", "/root/testdata/sf0.01"))
    rows = [r for r in q.op4_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(rows) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_toxicity_query_on_held_out_documents(spark):
    toxic = dict(table("labels", "doc_id, toxic", "/root/testdata/sf0.1"))
    rows = [r for r in q.op8_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in toxic]
    clean = [r for r in rows if not toxic[r.doc_id]]
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert sum(r.predicted == toxic[r.doc_id] for r in rows) >= 0.94 * len(rows)
