"""A small table with every awkward case: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, akey long, spans string, ids string"


def texts(seed: int = 3) -> list[str | None]:
    rng = random.Random(seed)
    vocab = ["al", "be", "ché", "dä", "el", "fi", "gu", "ho", "ij", "ké", "lo", "mi", "nu", "op", "qu", "ro"]
    say = lambda n: " ".join("".join(rng.choice(vocab) for _ in range(rng.randint(1, 3))) for _ in range(n))
    passage, line = say(40), say(15)
    base = [say(rng.randint(1, 120)) for _ in range(25)]
    out: list[str | None] = [None, "", " \t\n", "one", "one two three four", *base, *base[:4], base[5], None, ""]
    out += [f"{say(9)} {passage} {say(7)}" for _ in range(6)] + [passage, line, f"{line}\n{line}\n{line}", "ab" * 400, "x" * 130]
    for b in base[8:16]:  # near copies
        w = (b + " " + say(60)).split(" ")
        out.append(" ".join(w))
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [say(6000), base[6].upper(), "\x1c".join(base[7].split(" ")), "é" * 120]
    return out


def rows(seed: int = 3) -> list[tuple]:
    out = [(3 * k + 1, t, ["en", "fr", None][k % 3], f"src{k % 2}", len(t or ""), 0.5, k, "s", "i") for k, t in enumerate(texts(seed))]
    out += [out[8], (None, "nobody's words", "en", "src0", 3, 0.1, 1, "s", "i")]
    random.Random(1).shuffle(out)
    return out


def documents(spark, seed: int = 3):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(5)


def distinct(seed: int = 3) -> dict[int, str]:
    return {r[0]: r[1] or "" for r in rows(seed) if r[0] is not None}
