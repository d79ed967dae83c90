"""Windows of many texts are cut in little memory, and hold what each text holds."""

import random
import tracemalloc

import pyarrow as pa

from sparloom.llm.langid import CUT, cut_windows


def test_windows_in_little_memory():
    rng = random.Random(4)
    texts = ["".join(rng.choices("abé Z", k=rng.choice([0, 1, 7, 255, 256, 257, 600]))) for _ in range(6000)] + [None, ""]
    sample = pa.array(texts, pa.string()).fill_null("")
    cut_windows(sample[:1])
    tracemalloc.start()
    windows, owner, weight = cut_windows(sample)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(windows) > 4 * CUT and peak < 4 * windows.nbytes + 16 * 256 * CUT
    at = 0
    for i, text in enumerate(texts):
        body = (text or "").lower().encode()
        for place in range(0, len(body), 256):
            start = max(min(place, len(body) - 256), 0)
            assert (windows[at].tobytes(), owner[at], weight[at]) == (body[start : start + 256].ljust(256, b"\0"), i, min(256, len(body) - place))
            at += 1
    assert at == len(windows)
    assert len(cut_windows(pa.array(["", ""]))[0]) == len(cut_windows(pa.array([], pa.string()))[0]) == 0
