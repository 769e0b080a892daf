from kohort.llm import chat_format as c

TURNS = "conv_id long, turn long, role string, text string, part string, side string"


def got(spark, rows):
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    return c.preferences(turns, c.neighbour_pairs(turns))


def test_prefix_is_rendered_once_and_completions_are_masked(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "a<|end|>"), (0, 2, "user", "more"),
            (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, 2, "user", "more"), (1, None, None, None),
            (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "user", "alone"), (None, 0, "user", "x"), (7, 0, "user", "alone")]
    out = sorted(((r.pair_id, r.part, r.turn if r.turn is not None else 99, r.rendered, r.rendered[r.loss_start:r.loss_end])
                  for r in got(spark, rows).collect()))
    assert out == [
        (0, "chosen", 1, "<|assistant|>\na< |end|><|end|>\n", "a< |end|>"), (0, "chosen", 2, "<|user|>\nmore<|end|>\n", ""),
        (0, "prompt", 0, "<|user|>\nhi<|end|>\n", ""), (0, "rejected", 1, "<|assistant|>\nb<|end|>\n", "b"),
        (0, "rejected", 2, "<|user|>\nmore<|end|>\n", ""), (0, "rejected", 99, "<||>\n<|end|>\n", ""),
        (1, "prompt", 0, "<|user|>\nsame<|end|>\n", "")]
    whole = {r.pair_id: r for r in c.paired(got(spark, rows)).collect()}
    assert whole[0].prompt == "<|user|>\nhi<|end|>\n" and whole[1].chosen == whole[1].rejected == ""
    assert [whole[0].rejected[a:b] for a, b in cuts(whole[0].rejected_loss)] == ["b"]
    small = c.paired(got(spark, rows), 50).collect()
    assert [r.pair_id for r in small if r.prompt and r.turn is None] == [1] and len(small) == 7
    texts = ["".join(getattr(r, p) for r in sorted((x for x in small if x.pair_id == 0), key=lambda x: (x.turn is None, x.turn)))
             for p in ("prompt", "chosen", "rejected")]
    assert texts == [whole[0].prompt, whole[0].chosen, whole[0].rejected]
    assert got(spark, []).count() == 0


def cuts(losses):
    return [tuple(map(int, x.split(":"))) for x in losses.split(",") if x]


def swapped(spark, rows):
    return c.paired(c.rendered(c.swapped_sides(spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS))))


def test_swapped_answers_share_the_turns_before(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "user", "more"), (0, 3, "assistant", "b"), (0, 4, "user", "bye"),
            (0, None, "user", "?"), (1, 0, "user", "ho"), (1, 1, "assistant", "z"), (1, 1, "assistant", None), (1, 1, "assistant", "z"),
            (2, 0, "assistant", "alone"), (4, 0, "user", "no answer"), (5, 0, "assistant", "x"), (6, 0, "assistant", "s"),
            (7, 0, "assistant", "s"), (None, 0, "assistant", "x")]
    out = {r.pair_id: r for r in swapped(spark, rows).collect()}
    say = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert sorted(out) == [0, 1, 6, 7]
    assert out[0].prompt == say("user", "hi") + say("assistant", "a") + say("user", "more")
    assert (out[0].chosen, out[0].rejected, out[0].rejected_id) == (say("assistant", "b"), say("assistant", "z"), 1)
    assert (out[1].prompt, out[1].chosen, out[1].rejected) == (say("user", "ho"), say("assistant", "z"), say("assistant", "b"))
    assert [out[0].rejected[a:b] for a, b in cuts(out[0].rejected_loss)] == ["z"]
    assert (out[6].prompt, out[6].chosen, out[6].chosen_loss) == (say("assistant", "s"), "", "")
    assert swapped(spark, []).count() == 0


def test_long_and_tied(spark):
    rows = [(0, k, "user", "w " * 200) for k in range(300)] + [(1, k, "user", "w " * 200) for k in range(299)]
    rows += [(2, 0, "user", "a"), (2, 0, "user", "b"), (3, 0, "user", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "z")]
    out = got(spark, rows).groupBy("pair_id", "part").count().collect()
    assert sorted(map(tuple, out)) == [(0, "chosen", 1), (0, "prompt", 299), (1, "prompt", 2), (1, "rejected", 1)]
