"""Invented texts."""

import random


def prose(seed, words, vocabulary=4000):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(words))


def edited(text, seed, share):
    draw, words = random.Random(seed), text.split(" ")
    for i in range(len(words)):
        if draw.random() < share:
            words[i] = f"e{draw.randrange(10**6)}"
    return " ".join(words)
