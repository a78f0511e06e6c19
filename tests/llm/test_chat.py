from lectern.llm import chat

DDL = "pair_id long, turn long, role string, text string, prompt string, chosen string"


def brute(chosen, rejected):
    key = lambda t: [(x is not None, x if x is not None else "") for x in t]
    a, b = sorted(chosen, key=key), sorted(rejected, key=key)
    n = 0
    while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
        n += 1
    fix = lambda s: s.replace("<|", "< |")

    def show(turns):
        out, spans = "", []
        for _, role, text in turns:
            out += f"<|{fix(role if role is not None else 'unknown')}|>\n"
            start = len(out)
            out += fix(text or "") + "<|end|>"
            if role == "assistant":
                spans.append(f"{start}:{len(out)}")
            out += "\n"
        return out, ",".join(spans)

    return (n, show(a[:n])[0], *show(a[n:]), *show(b[n:]))


def test_brute_force(spark):
    u, s = "user", "assistant"
    pairs = {
        1: ([(0, u, "hi"), (1, s, "yes 😀"), (2, u, "x")], [(0, u, "hi"), (1, s, "no")]),
        2: ([(0, u, "a"), (1, s, "b")], [(5, u, "a"), (9, s, "b")]),
        3: ([(0, u, "only chosen"), (1, s, "<|end|> <|user|>")], []),
        4: ([], [(0, None, None), (1, s, None)]),
        5: ([(0, u, None), (1, s, "q")], [(0, u, ""), (1, s, "q")]),
        6: ([(0, u, "t"), (0, u, "t"), (None, "system", "s")], [(0, u, "t"), (0, s, "t"), (None, "system", "s")]),
        7: ([(i, s if i % 2 else u, f"turn {i}") for i in range(500)], [(i, s if i % 2 else u, f"turn {i}" if i < 499 else "z" * 100_000) for i in range(500)]),
        None: ([(0, u, "n")], [(0, u, "m")]),
    }
    frames = [spark.createDataFrame([(p, *t, "c", "d") for p, sides in pairs.items() for t in sides[i]], DDL) for i in (0, 1)]
    got = {r.pair_id: tuple(r)[1:] for r in chat.format_preferences(*frames).collect()}
    assert got == {p: brute(*sides) for p, sides in pairs.items()}
    assert chat.format_preferences(frames[0].limit(0), frames[1].limit(0)).count() == 0


def test_swapped_replies(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "more"), (1, 0, "user", "p"), (1, 1, "assistant", "b"), (2, 0, "user", "alone"), (4, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in chat.swapped_replies(df).collect())
    assert got == [(0, 0, "user", "q"), (0, 1, "assistant", "b"), (1, 0, "user", "p"), (1, 1, "assistant", "a"), (2, 0, "user", "alone")]
