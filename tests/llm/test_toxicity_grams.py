import random

import numpy as np
import pyarrow as pa

from appcorpus.llm import toxicity


def brute_force(text):
    framed = f" {text.lower()} "
    return {framed[i : i + n] for n in toxicity.ORDERS for i in range(len(framed) - n + 1)}


def test_different_grams_stay_apart():
    pick = random.Random(3)
    text = "".join(pick.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(150_000))
    own = np.unique(np.concatenate(list(toxicity.grams(text))))
    assert len(own) == len(brute_force(text))
    # a long text holds no n-gram of another alphabet
    other = np.unique(np.concatenate(list(toxicity.grams("0123456789" * 9))))
    assert len(next(iter(toxicity.known(pa.array([text]), other)))) == 0
