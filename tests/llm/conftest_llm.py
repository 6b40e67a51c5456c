"""Helpers of the tests of this folder."""

WORDS = [f"w{i}ab" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))
