"""Token alignment against whole texts encoded one by one, links counted in dictionaries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_llm_operators import docs

from sparkquill.llm import catalog, token_alignment

FILES = tuple(str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(al, text):
    """(n_a, n_b, groups) of a whole text, by the ends of its tokens."""
    raw = (" " + text).encode()
    a, b = al.a.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)
    if b"".join(al.bytes_a[i] for i in a) != raw or b"".join(al.bytes_b[i] for i in b) != raw:
        return 0, 0, []
    ends = lambda ids, of: np.cumsum([len(of[i]) for i in ids]).tolist()
    ends_a, ends_b = ends(a, al.bytes_a), ends(b, al.bytes_b)
    groups, from_a, from_b, at_a, at_b = [], 0, 0, {e: i for i, e in enumerate(ends_a)}, {e: i for i, e in enumerate(ends_b)}
    for e in sorted(at_a.keys() & at_b.keys()):
        i, j = at_a[e] + 1, at_b[e] + 1
        groups.append((a[from_a:i], b[from_b:j]))
        from_a, from_b = i, j
    return len(a), len(b), groups


def by_brute_force(rows):
    al = token_alignment.aligner(FILES)
    each = [(i, *(plain(al, t) if t else (0, 0, []))) for i, t in rows]
    counts = Counter((g[0][-1], g[1][-1]) for *_, groups in each for g in groups)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, n_a, n_b, groups in each:
        links = [(a[-1], b[-1]) for a, b in groups]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((i, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=str)


def have(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


ROWS = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "  two  blanks "), (6, "a\tb\n\nc \n d\n"), (7, "carriage\r\nreturn; {\r\n}"), (8, "no break space  x"), (9, "don't they'll I'M"),
    (10, "mark ▁ itself"), (11, "ﬁne ünïcode 漢字 🙂🙂 naïve"), (12, "<|endoftext|> and <s> </s> <unk> <0x41>"), (13, "x" * 3000), (14, "0123456789 3.14 1,000"), (9, "don't they'll I'M"),
    (None, "no id"), (None, "no id"), (17, "\x00null\x00 \x1f\x7f"), (18, "(a) [b] {c}. \"d\" 'e' --f-- g!?"), (19, "　wide"), (20, "-" * 500 + " " * 500 + "\n" * 50), (21, "é combining"),
]


@pytest.mark.parametrize("height,hot", [(256, 4_000_000), (1000, 20), (7, 3)])
def test_alignment_odd_rows(spark, monkeypatch, height, hot):
    monkeypatch.setattr(token_alignment, "HOT_LINKS", hot)
    assert have(token_alignment.align(docs(spark, ROWS), *FILES, height)) == by_brute_force(ROWS)


def test_alignment_of_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert have(catalog.QUERIES["op12_token_alignment"](spark, sf)) == by_brute_force(rows)


def test_parts_encode_like_whole_texts():
    al = token_alignment.Aligner(*FILES)
    rng = np.random.default_rng(3)
    letters = [" ", " ", "\n", "\t", "a", "B", "é", "ing", "the", ".", ",", "'s", "1", "(", ")", "\"", "_", "漢", "--", "http://", " ", "\r"]
    assert al.cut
    for _ in range(3000):
        text = "".join(rng.choice(letters, int(rng.integers(1, 30))))
        parts = al.parts(text)
        assert "".join(parts) == " " + text
        al.learn([p for p in dict.fromkeys(parts) if p not in al.known])
        at = [al.known[p] for p in parts]
        n_a, n_b, groups = plain(al, text)
        want = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        assert ";".join(al.groups[i] for i in at) == want and sum(al.n_a[i] for i in at) == n_a and sum(al.n_b[i] for i in at) == n_b


def test_one_pair_of_ids_in_most_links(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "HOT_LINKS", 1000)
    rows = [(i, "the the the " * 40 + f"word{i}") for i in range(400)]
    assert have(token_alignment.align(docs(spark, rows).repartition(8), *FILES)) == by_brute_force(rows)
