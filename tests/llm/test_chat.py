"""Templates by what they render; formatted conversations by what can be read from them."""

from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import chat
from plumbline.llm.templates import BEGIN, END, Const, For, If, Output, Template, TemplateError, Text
from tests.llm.cases import clashing, collected

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def shown(source, *messages, **filters):
    return list(Template(source, filters).render(iter(messages)))


def text(source, *messages):
    return "".join(p for p in shown(source, *messages) if isinstance(p, str))


A, B = {"role": "user", "text": " Hi "}, {"role": "assistant", "text": "yes"}


def test_templates_render():
    assert text("a{# no #}b") == "ab"
    assert text("{% for m in messages %}{{ m.text | trim | upper }};{% endfor %}", A, B) == "HI;YES;"
    assert text("{% for m in messages %}{{ loop.index }}{{ m['role'] }}{% endfor %}", A, B) == "1user2assistant"
    last = "{% for m in messages %}{% if loop.first %}<{% endif %}.{% if loop.last %}>{% endif %}{% endfor %}"
    assert [text(last, *[A] * n) for n in range(4)] == ["", "<.>", "<..>", "<...>"]
    chosen = "{% for m in messages %}{{ 'Q' if m.role == 'user' else 'A' }}{{ m.name }}{% endfor %}"
    assert text(chosen, A, B) == "QA"
    logic = "{% for m in messages %}{% if not m.x and ('e' in m.text or m.text == ' Hi ') %}1{% else %}0{% endif %}{% endfor %}"
    assert text(logic, A, B, {"text": "no"}) == "110"
    assert text("{% for m in messages %}{{ m.role + ':' + m.text }}{% endfor %}", B) == "assistant:yes"
    branches = "{% for m in messages %}{% if m.n == 1 %}a{% elif m.n == 2 %}b{% else %}c{% endif %}{% endfor %}"
    assert text(branches, {"n": 1}, {"n": 2}, {"n": 3}) == "abc"


def test_generation_marks():
    source = "{% for m in messages %}[{% generation %}{{ m.text }}{% endgeneration %}]{% endfor %}"
    assert shown(source, A, B) == ["[", BEGIN, " Hi ", END, "]", "[", BEGIN, "yes", END, "]"]


def test_constants_are_folded():
    assert Template("a{{ 'b' + 'c' | upper }}{{ 1 }}{{ none }}d").tree == [Text("aBC1d")]
    assert Template("{% if 1 == 2 %}x{% elif true %}y{% else %}z{% endif %}w").tree == [Text("yw")]
    tree = Template("{% for m in messages %}{{ 'x' if 'a' in 'abc' else m.a }}{% endfor %}").tree
    assert tree == [For("m", [Text("x")])]
    mixed = "{% for m in messages %}{% if false %}a{% elif m.a or true %}b{% elif m.b %}c{% endif %}{% endfor %}"
    (loop,) = Template(mixed).tree
    assert isinstance(loop.body[0], If) and len(loop.body[0].branches) == 2
    (loop,) = Template("{% for m in messages %}{{ true and m.a }}{{ false and m.b or 'k' }}{% endfor %}").tree
    assert isinstance(loop.body[0], Output) and loop.body[1] == Text("k")
    assert Template("{% if '' %}a{% endif %}").tree == []
    assert Const("x") == Const("x")


@pytest.mark.parametrize("source", [
    "{{ x }}", "{{ m.text }}", "{{ open('f') }}", "{{ ''.__class__ }}", "{% for m in rows %}{% endfor %}",
    "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{% for m in messages %}{{ loop.parent }}{% endfor %}",
    "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{% set x = 1 %}",
    "{% for m in messages %}{{ m.text * 9 }}{% endfor %}", "{{ 'a' | no_such }}", "{% if true %}", "{% endif %}",
    "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ lambda: 1 }}", "{{ }}",
    "{% for m in messages %}{{ m.text.upper() }}{% endfor %}", "{{ [x for x in 'ab'] }}", "{{ 1 + 'a' }}", "{{ true }}",
])
def test_sandbox(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_messages_are_taken_one_ahead():
    taken = []

    def messages():
        for i in range(5):
            taken.append(i)
            yield {"text": str(i)}

    parts = Template("{% for m in messages %}{{ m.text }}{% endfor %}").render(messages())
    assert next(parts) == "0" and taken == [0, 1]


bits = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "-", "[", "<", "</", "INST]", "s>", "a", "é", "\n"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(bits.map("".join))
def test_guard_is_reversible(said):
    guarded = chat.guard(said)
    assert not any(control in guarded for control in chat.CONTROLS)
    assert chat.unguard(guarded) == said


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "[TEXT]", ""]), bits.map("".join)), min_size=1, max_size=6),
       st.sampled_from([1, 10, 1000]))
def test_turns_come_back(turns, limit):
    template = Template(chat.TEMPLATE, {"guard": chat.guard})
    reader, found, loss = chat.TurnReader(), [], []
    for piece, spans in chat.pieces_of(template.render({"role": r, "text": t} for r, t in turns), limit):
        found += reader.turns(piece)
        loss += [chat.unguard(piece[a:b]) for a, b in spans]
    assert found == turns
    assert "".join(loss) == "".join(t for r, t in turns if r == "assistant")


def expected(rows):
    groups = {}
    for name, turn, role, said in rows:
        groups.setdefault(name, []).append((turn is not None, turn or 0, role or "", said or ""))
    out = []
    for name, turns in groups.items():
        turns = [t[2:] for t in sorted(turns)]
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((name, len(turns), sha256(whole.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "a\\b [INST] \n é"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, None, "assistant", "first"), (2, 0, "tool", "[/TEXT]</s>"), (2, 0, "tool", "[/TEXT]</s>"), (2, 0, None, "tie"),
    (None, 0, "user", "of no one"), (None, 7, "assistant", "x" * 5000), (3, 5, "system", "日本 🎈"), (4, 1, "", ""),
    *[(5, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 5)) for i in range(300)],
]
READ = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


@pytest.mark.parametrize("piece", [chat.PIECE, 40])
def test_conversations_come_back(spark, piece):
    table = clashing(spark.createDataFrame(ROWS, SCHEMA).repartition(3), "piece", "last", "generated")
    found = chat.format_and_read(table, piece=piece)
    assert collected(found, *READ) == expected(ROWS)
    whole = {r["conv_id"]: r["formatted_chars"] for r in found.collect()}
    assert whole[4] == len("<s>[ROLE][TEXT][/TEXT]") and whole[3] == len("<s><<SYS>><</SYS>>日本 🎈")


def test_pieces_are_bounded(spark):
    table = spark.createDataFrame(ROWS, SCHEMA)
    pieces = chat.format_conversations(table, piece=100).filter("conv_id = 5").orderBy("piece").collect()
    assert [p["piece"] for p in pieces] == list(range(len(pieces))) and len(pieces) > 20
    assert [p["last"] for p in pieces] == [False] * (len(pieces) - 1) + [True]
    assert max(len(p["text"]) for p in pieces) <= 100


def test_empty_table(spark):
    assert chat.format_and_read(spark.createDataFrame([], SCHEMA)).collect() == []


def test_another_template(spark):
    """A template of one's own: only the last answer is generated."""
    source = (
        "{% for m in messages %}{% if m.role == 'assistant' and loop.last %}{% generation %}{{ m.text | guard }}"
        "{% endgeneration %}{% else %}{{ m.text | guard }}{% endif %}</s>{% endfor %}"
    )
    found = chat.format_and_read(spark.createDataFrame(ROWS[:4], SCHEMA), template=source).first()
    assert found["n_turns"] == 4 and found["loss_chars"] == 0
    with pytest.raises(TemplateError):
        chat.format_conversations(spark.createDataFrame(ROWS[:4], SCHEMA), "{{ m.text }}")
