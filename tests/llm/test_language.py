import collections
import random

import numpy as np

from quillgrid.llm import language


def test_trigrams_of_texts_in_stretches(monkeypatch):
    """Cutting a text into stretches, whatever their length, changes no trigram count."""
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 9, 40):
        text = "".join(rng.choice("ab  1.é") for _ in range(n))
        words = "".join(ch if ch.isalpha() else " " for ch in text).split()
        flat = " " + " ".join(words) + " " if words else ""
        want = sorted(collections.Counter(flat[i : i + 3] for i in range(len(flat) - 2)).values())
        for stretch in (1, 2, 3, 7, 1 << 20):
            monkeypatch.setattr(language, "STRETCH", stretch)
            keys, counts = language.Letters().counts(text)
            assert sorted(counts.tolist()) == want, (text, stretch)
            assert len(np.unique(keys)) == len(keys)
