import random


def words(n, seed=0, vocabulary=5000):
    r = random.Random(seed)
    return " ".join("w" + format(r.randrange(vocabulary), "x") for _ in range(n))
