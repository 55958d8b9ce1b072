"""Bars of random walks that tests share."""

import random

BARS = "symbol string, x long, open double, high double, low double, close double, volume double, amount double"


def walk(seed, n=260):
    rng = random.Random(seed)
    price, rows = 50.0, []
    for x in range(n):
        open_, price = price, round(max(5.0, price + rng.choice((-2.5, -1, -0.5, 0, 0.5, 1, 2.5))), 2)
        up, down = rng.choice((0.0, 0.4, 1.1)), rng.choice((0.0, 0.4, 1.1))
        volume = float(rng.randrange(1, 9))
        rows.append((f"w{seed}", x, open_, max(open_, price) + up, min(open_, price) - down, price, volume, volume * price))
    return rows
