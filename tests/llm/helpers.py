"""Small tables with the awkward rows every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves, as extra columns of the input.
CLASHING = "start long, stop long, keeper string, key string, root string, node string, digest string, word string"


def prose(seed, words, vocabulary=2_000):
    draw = random.Random(seed)
    names = ["".join(draw.choice("aeioulnrst") for _ in range(draw.randint(2, 7))) for _ in range(vocabulary)]
    return " ".join(draw.choice(names) for _ in range(words))


def documents(spark, rows):
    """Rows ``(doc_id, text)`` or ``(doc_id, text, lang)`` as a documents table with clashing extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "xx", "src0", None, 7, 8, *["x"] * 6) for r in rows]
    return spark.createDataFrame(full, f"{SCHEMA}, {CLASHING}")


AWKWARD = [
    (None, "a row without an id"),
    (90, None),
    (91, ""),
    (92, " \t\n "),
    (93, "\x1c odd \x1d separators \x85 and spaces"),
    (94, "<|endoftext|> in a text <|startoftext|>!"),
    (95, "Straße ΣΑΣ é ǅ 한국 \U0001f600 1½ don't I'LL"),
    (96, "one"),
    (97, "two words"),
    (98, "copy of a row"),
    (98, "copy of a row"),
    (99, "\n\nlines\n\n with  double   spaces \n"),
]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def components_of(nodes, linked):
    """Brute force: smallest reachable node per node."""
    nodes = sorted(set(nodes))
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
