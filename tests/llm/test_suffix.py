import random
import time

import numpy as np
import pytest

from hashwood.llm import suffix as S


def key(text, p):
    return text[p : text.index(0, p) + 1]


@pytest.mark.parametrize("letters,size,parts", [(2, 60, 3), (3, 200, 10), (26, 300, 5), (255, 400, 4), (1, 40, 6), (4, 0, 0)])
def test_sorted(letters, size, parts):
    rng = random.Random(letters * size)
    for _ in range(15):
        text = b"".join(bytes(rng.randint(1, letters) for _ in range(rng.randint(1, size))) + b"\0" for _ in range(rng.randint(1, parts))) if parts else b"\0"
        raw = np.frombuffer(text, np.uint8)
        found = S.suffix_array(raw).tolist()
        assert sorted(found) == list(range(len(text)))
        keys = [key(text, p) for p in found]
        assert keys == sorted(keys)


def test_common_words():
    text = b"abcdefghijklmnopqrstuvwxyz\0xbcdefghijklmnopqrstuvwxyz\0"
    raw = np.frombuffer(text, np.uint8)
    array = S.suffix_array(raw)
    words = S.common_words(raw, array, 3)
    order = {p: i for i, p in enumerate(array.tolist())}
    for p in range(len(text)):
        if order[p]:
            q = array[order[p] - 1]
            same = 0
            while same < 24 and (text[p : p + same + 1] + b"\0" * 40)[same : same + 1] == (text[q : q + same + 1] + b"\0" * 40)[same : same + 1] and p + same < len(text) and q + same < len(text):
                same += 1
            assert words[p] == min(3, same // 8) or p + 24 > len(text) or q + 24 > len(text)
