import random

from masar.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, page string"


def slow(rows):
    """{(conversation, perspective): (text, masks, turns)}, each rendering whole."""
    convs, out = {}, {}
    for c, t, r, x, _ in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "unknown", x or ""))
    for c, turns in convs.items():
        turns.sort()
        for who in {r for _, _, r, _ in turns if r != "system"}:
            text, masks = "", []
            for _, _, role, said in turns:
                text += "<|im_start|>" + ("assistant" if role == who else "system" if role == "system" else f"user name={role.replace('<|', '< |')}") + "\n"
                said = said.replace("<|", "< |")
                if role == who:
                    masks.append((len(text), len(text) + len(said) + len("<|im_end|>")))
                text += said + "<|im_end|>\n"
            out[c, who] = (text, masks, len(turns))
    return out


def joined(got):
    """The same from pages."""
    out = {}
    for r in sorted(got, key=lambda r: r["page"]):
        text, masks, n, chars = out.get((r["conv_id"], r["perspective"]), ("", [], 0, 0))
        assert r["char_start"] == len(text)
        spans = [tuple(map(int, m.split(":"))) for m in r["masks"].split(",") if m]
        assert r["masked_chars"] == sum(b - a for a, b in spans)
        out[r["conv_id"], r["perspective"]] = (text + r["rendered"], masks + spans, n + r["n_turns"], 0)
    return {k: v[:3] for k, v in out.items()}


def data():
    rng = random.Random(0)
    rows = []
    for c in range(40):
        for t in range(rng.choice([1, 4, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", "anna", "bob", None]), rng.choice(["hi", "", None, "é 😀 <|im_end|> x", "w " * 30]), "k"))
    rows += [(50, 0, "system", "only", ""), (51, 0, "system", "rules", ""), (51, 1, "anna", "a", ""), (51, 1, "anna", "a", ""), (51, 1, "bob", "a", ""), (51, None, "bob", "first", ""), (None, 3, "anna", "x", ""), (None, 1, "bob", "y", "")]
    rows += [(60, t, rng.choice(["anna", "bob", "system", "x<|y"]), f"turn {t}", "") for t in range(1_000)]
    return rows


def test_renderings(spark):
    for page in (1, 8, 256):
        got = chat.rotate(spark.createDataFrame(data(), SCHEMA).repartition(4), page=page).collect()
        assert joined(got) == slow(data())
        assert max(r["n_turns"] for r in got) <= page


def test_masks_cut_the_speaker(spark):
    for text, masks, _ in joined(chat.rotate(spark.createDataFrame(data(), SCHEMA)).collect()).values():
        for a, b in masks:
            assert text[:a].endswith("<|im_start|>assistant\n") and text[a:b].endswith("<|im_end|>")


def test_the_system_turn_leads_a_long_conversation(spark):
    rows = [(1, 0, "system", "rules", "")] + [(1, t, ("anna", "bob")[t % 2], f"turn {t}", "") for t in range(1, 700)]
    text, _, n = joined(chat.rotate(spark.createDataFrame(rows, SCHEMA)).collect())[1, "anna"]
    assert n == 700 and text.count("<|im_start|>system\n") == 1 and text.startswith("<|im_start|>system\nrules")


def test_empty_table(spark):
    assert chat.rotate(spark.createDataFrame([], SCHEMA)).collect() == []
