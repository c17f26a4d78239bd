"""Models the tests bring."""

import hashlib
import math
import re


def toy_embed(text):
    """Hashing bag of words, one bucket per token, unit length."""
    vector = [0.0] * 64
    for token in re.findall("[a-z0-9]+", text.lower()):
        vector[int(hashlib.sha1(token.encode()).hexdigest()[:8], 16) % 64] += 1.0
    size = math.sqrt(sum(v * v for v in vector))
    return [v / size for v in vector] if size else vector


def toy_factory(model):
    return lambda texts: [toy_embed(t) for t in texts]


def sign_factory(model):
    return lambda paths: [f"No mooring, read by {model}" for _ in paths]
