from quillspan.llm import mail

T = "conv_id bigint, turn int, content string, source_format string, sender string, ingested_at timestamp, known string, h string"
ONE = "Could you review the harbour chart before Friday? The lantern circuit still drops nine readings per run."
TWO = "We should rename the field notebook after the trial."


def new(content, sender="Ada Byron <ada@x.example>"):
    lines = mail.lines_of(content)
    return [lines[k] for k in mail.analyse(lines, sender, set(), set())]


def test_pieces_do_not_depend_on_what_stands_around():
    words = [f"word{i}" for i in range(400)]
    whole, part = mail.pieces(" ".join(words)), mail.pieces(" ".join(words[37:351]))
    assert len(set(part) & set(whole)) >= len(part) - 2 and len(part) > 15


def test_part_of_a_quoted_sentence_is_found():
    old = " ".join(f"earlier{i} talk{i}" for i in range(60))
    known = {mail.hash64(p) for p in mail.pieces(old)}
    part = " ".join(old.split()[9:100])
    lines = ["Right, see below.", "", *[" ".join(part.split()[i : i + 6]) for i in range(0, 91, 6)]]
    covered = mail.covered_lines(lines, known)
    assert not covered[0] and covered[5:-2].all()


def test_closings_are_learned_from_many_threads(spark):
    notice = "Whoever reads this page without being asked\nmust forget it before the next full moon rises."
    rows, say = [], lambda k: f"{'abcdef'[k]}lpha {'ghijkl'[k]}amma speaks of {'mnopqr'[k]}hinges, and of nothing else that matters."
    for k in range(6):
        rows.append((k, 0, f"Hello,\n\n{say(k)}\n\nToodle pip\nAda\nKeeper of Maps\n\n{notice}", "email", "Ada Byron <ada@x.example>", None, None, None))
    rows.append((9, 0, f"Another thing altogether that was not said before.\n\nToodle pip, Bo\n\n{notice}", "email", "Bo Key", None, None, None))
    got = {r.conv_id: r.text for r in mail.new_texts(spark.createDataFrame(rows, T)).collect()}
    assert got[9] == "Another thing altogether that was not said before."
    assert all(got[k] == f"Hello,\n{say(k)}" for k in range(6))


def test_header_closing_and_signature():
    t = f"From: Ada Byron <ada@x.example>\nSent: 1 Jan 2025\nTo: Bo\nSubject: x\n\nHi Bo,\n\n{ONE}\n- {TWO}\n\nBest regards,\nAda\nEditor, Lower Annex\nTel. 000 555 0100\n[image: logo]\n\nP.S. {TWO}\n\n-----\nThis message is confidential and meant only for the addressee."
    assert new(t) == ["Hi Bo,", ONE, f"- {TWO}", f"P.S. {TWO}"]


def test_prefixed_quotes_with_answers_between():
    t = f"On 3 Mar 2025 at 10:02, Bo Key via intake <bo@y.example>\nwrote:\n> Hi Ada,\n> {ONE}\n{TWO}\n\n> more of it\nYes.\n\nAda"
    assert new(t) == [TWO, "Yes."]


def test_unmarked_quotes_to_the_end():
    for intro in ("-----Original Message-----", "Begin forwarded message:", "Bo Key <bo@y.example> wrote on 3 Mar 2025:", "Le 3 Mar 2025, Bo Key <bo@y.example> a écrit :", "*From:* Bo Key <bo@y.example>\n*Sent:* 3 Mar 2025\n*To:* Ada", "Am 3 Mar 2025 schrieb Bo Key <bo@y.example>:"):
        assert new(f"{TWO}\n\n{intro}\n\nHello,\n{ONE}\n\nBo") == [TWO]


def test_text_that_only_looks_like_marks():
    t = "On Tuesday Bo wrote the summary: it is short but right.\n-- two dashes at the start of a line still break it.\nSubject: matter experts are still missing.\nBo wrote:\nthe shelf is full. I read that twice.\nThanks to Bo the shelf is labelled."
    assert new(t) == t.split("\n")


def test_mail_passed_on_as_a_whole():
    assert new(f"From: Bo Key <bo@y.example>\nSent: 1 Jan 2025\nTo: Ada\n\n{ONE}\n\nBo") == []


def test_threads(spark):
    # the earlier text comes back without any mark, wrapped anew; only the thread shows it
    body = " ".join([ONE, TWO, "Nobody remembers why the granary uses a spare filter."])
    again = body.replace(" the ", "\nthe ", 3)
    rows = [
        (1, 0, f"Hi,\r\n\r\n{body}\r\n\r\nBest,\r\nBo", "email", "Bo Key", None, "k", "h"), (1, 1, f"Fine by me, go on with it.\n\n{again}", "Email ", None, None, "k", "h"),
        (1, 1, f"Fine by me, go on with it.\n\n{again}", "Email ", None, None, "k", "h"), (2, 0, again, "email", None, None, None, None),
        (3, 0, None, "email", None, None, None, None), (3, 1, "", "email", None, None, None, None), (None, 1, "x", "email", None, None, None, None), (4, None, "No turn number.", "email", None, None, None, None), (5, 0, "chat", "markdown", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, T)
    got = {(r.conv_id, r.turn, r.line_no) for r in mail.new_lines(df).collect()}
    n = again.count("\n") + 1
    assert got == {(1, 0, 0), (1, 0, 2), (1, 1, 0), (4, None, 0)} | {(2, 0, k) for k in range(n)}
    assert {r.text for r in mail.new_texts(df).where("conv_id = 1 AND turn = 1").collect()} == {"Fine by me, go on with it."}
    assert mail.new_lines(df.limit(0)).count() == 0
