from __future__ import annotations

import random
import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return WORDS.findall(text)


def prose(rng: random.Random, n: int) -> list[str]:
    return [rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz ß é ñ Ж".split()) + rng.choice("aeiou") + str(rng.randrange(60)) for _ in range(n)]


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Texts with exact and near copies, shared passages, repeats inside a text, and all kinds of odd texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([3, 5, 30, 120, 300])) for _ in range(n)]
    passage = prose(rng, 70)
    for k in range(0, n, 6):
        base[k] = base[k] + passage + prose(rng, 5)
    texts = [" ".join(b) for b in base]
    for _ in range(n // 2):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 12])):
            at = rng.randrange(max(1, len(b)))
            b[at : at + 1] = rng.choice([[], prose(rng, 1), [*b[at : at + 1] * 2]])
        texts.append((rng.choice([" ", "\n", "\t "])).join(b))
    run = "go " * 130
    texts += [None, "", "  \n ", "one", "One", "one two three four", "a b c d e", "A B C D E", run, run + "x", " ".join(prose(rng, 20_000)), "go stop " * 80, "x" * 5000]
    ids = rng.sample(range(10 * len(texts)), len(texts))
    return list(zip(ids, texts, strict=True))


#: Names that the operators use inside.
CLASHING = "n d1 d2 sketch rep component node key s h range place ids kind gone label v at low high flag"


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = corpus()
    extra = CLASHING.split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame([(i, t, "en", None, None, *["x"] * len(extra)) for i, t in rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
