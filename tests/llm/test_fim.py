import hashlib
import random
import re

import pytest

from scenelake.llm import fim


def plainly(doc_id, text):
    """The same rule with string slices."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_random_texts():
    draw = random.Random(3)
    parts = ["a", "\n", "\r\n", "é", "日本", "🙂", "<", ">", "<P", "S>", "<M>", "\x00", " ", " "]
    for doc_id in range(3000):
        text = "".join(draw.choices(parts, k=draw.randrange(30)))
        n, form, before, middle, output = fim.transform_one(text.encode(), fim.draws(doc_id))
        assert (n, form, before, middle, bytes(output).decode()) == plainly(doc_id, text)
        assert bytes(fim.restore_one(bytes(output), form)).decode() == text


@pytest.mark.parametrize("start,cut,end", [(0, 0, 5), (1, 3, 6), (0, 6, 6), (2, 4, 5)])
def test_rotation(start, cut, end):
    block = bytearray(b"abcdef")
    fim.rotate(block, start, cut, end)
    assert bytes(block) == b"abcdef"[:start] + b"abcdef"[cut:end] + b"abcdef"[start:cut] + b"abcdef"[end:]


def test_rates():
    numbers = fim.draws(5)
    assert fim.transform_one(b"a\nb", numbers, rate=0)[1] == "plain"
    assert fim.transform_one(b"a\nb", numbers, spm_rate=100)[1] == "spm"
    assert fim.transform_one(b"a\nb", numbers, spm_rate=0)[1] == "psm"


def test_odd_rows(odd, none):
    rows = odd.collect()
    restored = fim.restore(fim.transform(odd))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in restored.collect()), key=repr)
    assert got == sorted(((r.doc_id, *plainly(r.doc_id, r.text or "")) for r in rows), key=repr)
    assert sorted(r.restored for r in restored.collect()) == sorted(r.text or "" for r in rows)
    assert fim.digests(fim.restore(fim.transform(none))).count() == 0
