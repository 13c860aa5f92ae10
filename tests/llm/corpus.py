"""Small corpora with every awkward case, and plain versions of the operators to hold them against."""

import random
import re

from gridwatt.llm.mixing import WORD

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AZ = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(WORD, (text or "").translate(AZ))


def documents(seed=0, n=60):
    """Rows with near copies, exact copies, nulls, empty texts, one-word texts, a long text, repeated rows and shared ids."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijß") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = text(70)
    rows = []
    for i in range(n):
        t = text(r.randint(1, 80))
        if i % 5 == 1:
            w = rows[r.randrange(len(rows))][1]
            w = (w or "x").split(" ")
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            t = " ".join(w)
        if i % 7 == 3:
            t = t + "\n" + passage
        rows.append((i, t, r.choice(["aa", "bb", None]), f"s{i % 3}" if i % 11 else None, len(t)))
    rows += [(1000, None, "aa", None, None), (1001, "", None, "s1", 0), (1002, " \n\t ", "bb", "s1", 4), (None, rows[5][1], "aa", "s0", 1), (1003, "One", "aa", "s0", 3),
             (1004, "one", "aa", "s0", 3), (1005, text(3000), "bb", "s2", 1), rows[7], rows[7], (8, text(40), None, "s2", 1)]
    return rows
