"""Invented prose."""

WORDS = [a + b for a in ("tal", "mer", "sor", "vin", "kel", "dra", "pho", "quin", "bar", "ost") for b in ("an", "ique", "o", "eth", "us", "ing", "ar", "ly", "em", "ude", "ish", "on")]


def prose(rng, n):
    out = []
    while len(out) < n:
        k = min(rng.randint(4, 14), n - len(out))
        s = rng.choices(WORDS, k=k)
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."] if k > 1 else [s[0].capitalize() + "."]
    return " ".join(out)
