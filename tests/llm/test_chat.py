import hashlib

from hypothesis import given, settings, strategies as st

from tidemark.llm import chat_format as c

PIECES = st.lists(st.sampled_from(["<", "|", "\\", "<|im_start|>", "<|im_end|>", "\n", "a", "im_end", ">", "é", ""]), max_size=9).map("".join)


@settings(max_examples=500, deadline=None)
@given(PIECES, PIECES)
def test_every_turn_survives(role, text):
    piece, a, b = c.render(role, text)
    assert [t[:2] for t in c.parse(piece)] == [(role, text)]
    assert c.unescape(piece[a:b]) == text
    assert [t[:2] for t in c.parse(piece * 3)] == [(role, text)] * 3


def test_plain_text_stays_as_it_is():
    assert c.render("user", "a < b | c") == ("<|im_start|>user\na < b | c<|im_end|>\n", 17, 26)
    assert c.parse("<|im_start|>user\nno end") is None


def brute(rows):
    out, groups = [], {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(role or "", text or "") for _, _, role, text in turns]
        loss = "".join(t for role, t in turns if role == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_digests(spark):
    rows = [(1, 1, "assistant", "ok <|im_end|>"), (1, 0, "user", c.CONFLICT), (2, None, None, None), (2, 0, "assistant", ""), (None, 3, "assistant", "x\n" * 9), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (4, 0, "us\ner\\", "z" * 100_000)]
    rows += [(5, i, "assistant" if i % 2 else "user", f"t{i} 🙂") for i in range(3000)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, piece int, n_turns int")
    got = sorted((tuple(r)[:5] for r in c.read_back(c.format_turns(table)).collect()), key=repr)
    assert got == brute(rows)
    assert c.read_back(c.format_turns(table.limit(0))).collect() == []
