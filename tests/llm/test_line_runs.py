"""Line runs of every length against brute force."""

import random

from weirflow.llm import line_dedup


def test_runs_of_any_length(spark):
    """Short lines, so that runs of 3, 5, 6, 7, ... lines reach 20 characters only as a whole."""
    rng = random.Random(8)
    texts = ["title one\nsub two\nline three", "other\ntitle one\nsub two\nline three\nend"]
    texts += ["\n".join(f"ab{i}x" for i in range(7)), "x\n" + "\n".join(f"ab{i}x" for i in range(7)) + "\ny"]
    pool = [f"{'v' * rng.randint(0, 5)}{i % 4}" for i in range(6)] + ["", "ab", "a line of more than twenty"]
    menu = [rng.choice(pool) for _ in range(60)]
    for _ in range(60):
        at = rng.randrange(len(menu))
        texts.append("\n".join(menu[at : at + rng.randint(1, 20)] + [rng.choice(pool) for _ in range(rng.randint(0, 6))]))
    # Copies of copies that end at different lines: the longest earlier run is not at the earliest place.
    texts += ["\n".join([f"{i}c" for i in range(20)][: rng.randint(8, 20)] + [f"z{k}"]) for k in range(12)]
    docs = list(enumerate(texts))
    seen, gone = set(), {}
    for d, text in docs:
        lines = text.split("\n")
        gone[d] = set()
        for i in range(len(lines)):
            runs = [tuple(lines[i : i + n]) for n in range(1, len(lines) - i + 1)]
            for run in runs:
                if run in seen and sum(map(len, run)) >= 20:
                    gone[d] |= set(range(i, i + len(run)))
            seen |= set(runs)
    got = line_dedup.remove_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs) and gone[1] == {1, 2, 3} and gone[3] == set(range(1, 8))
    for r in got:
        left = [x for i, x in enumerate(r.text.split("\n")) if i not in gone[r.doc_id]]
        assert (r.n_removed, r.kept) == (len(gone[r.doc_id]), "\n".join(left)), r
