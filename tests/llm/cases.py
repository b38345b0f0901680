"""Documents with every awkward shape: nulls, empty and long texts, ties, repeats, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, kept boolean, hash string"
WORDS = "alpha beta gamma delta river stone cloud maple north quiet amber field glass honey lemon ocean piano tiger under violet".split()


def prose(seed, n):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        sentence = [r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.randint(5, 12))]
        out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + "."]
    return " ".join(out[:n])


def texts():
    base = prose(1, 300)
    near = base.split(" ")
    near[10] = "changed"
    lines = "\n".join(prose(s, 12) for s in range(30, 40))
    return [
        None, "", " \n\t ", "one", "two words", base, base, " ".join(near), prose(2, 40), prose(3, 2500) * 3, "Shared footer line here.\n" + prose(4, 60), "Shared footer line here.\n" + prose(5, 60),
        prose(6, 80) + " " + base[200:900] + " " + prose(7, 30), lines, "word " * 400, "ÉTÉ naïve ß 漢字 " * 30, "Released under the MIT License. " + prose(8, 30), "MIT license or GNU General Public License or mit license", "*** $$$ ### " * 40, "A | B | C | D | E | F " * 20,
    ]


def rows():
    out = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t) if t is not None else None, 1, True, "x") for i, t in enumerate(texts())]
    out.append(out[5])  # a repeated row
    out.append((None, out[8][1], None, None, None, None, None, None))
    out.append((None, None, None, None, None, None, None, None))
    return out


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
