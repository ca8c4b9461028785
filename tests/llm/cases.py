"""Documents with the cases that every operator must take: nulls, empty and long texts, copies, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, component_id long, text_hash long"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(("alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta,", "theta.", "iota", "kappa")) + str(r.randrange(60)) for _ in range(n))


def documents() -> list[tuple]:
    passage = words(99, 90)
    texts = ["", None, "   ", "a", words(1, 5), words(2, 40), words(2, 40), words(3, 200), words(3, 200) + " end", words(4, 30) + " " + passage, passage + "\n" + words(5, 60), words(6, 9000), "x" * 5000, "日本語 テキスト " * 40, "a\0b\x1c c\x85d " * 60, words(7, 120) + "\n" + words(7, 120)]
    rows = [(i, t, "en", f"s{i % 4}", None if t is None else len(t), 0.5, "f", 7, 9) for i, t in enumerate(texts)]
    rows.append((None, words(8, 50), None, None, None, None, None, None, None))
    rows.append(rows[5])  # a repeated row
    return rows


def frame(spark, rows=None, parts=3):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(parts)
