"""The parser of cards: YAML whole, everything else by lines without losing a card."""

import random
import time

import pytest
from pyspark.sql import functions as F

from paperloom.operators import cards as C
from paperloom.operators import evidence


def _cards(chunk):
    return [c["card"] for c in C.parse_chunk(chunk)[1]]


def test_whole_yaml_stays():
    company, cards, dropped, reason = C.parse_chunk("meta:\n  azienda: {nome: 'ALFA'}\nsezioni:\n- nome: 08\n  documenti:\n  - {tipo: A, titolo: \"x: y\", valido: yes, data: 2024-01-01}\n  - tipo: B\n    testo: |\n      | a | b |\n      riga\n    figli: [1, {k: v}]\n")
    assert (company, dropped, reason) == ("ALFA", [], None) and [c["section"] for c in cards] == ["08", "08"]
    assert cards[0]["card"] == {"tipo": "A", "titolo": "x: y", "valido": "yes", "data": "2024-01-01"}
    assert cards[1]["card"] == {"tipo": "B", "testo": "| a | b |\nriga", "figli": '["1", {"k": "v"}]'}


@pytest.mark.parametrize(
    ("chunk", "cards", "dropped"),
    [
        # What one bad card used to take with it: the next one.
        ("- tipo: A\n  titolo: X\n  x: [1, 2\n- tipo: B\n  titolo: Y", [{"tipo": "A", "titolo": "X", "x": "[1, 2"}, {"tipo": "B", "titolo": "Y"}], [(3, "no closing ]: kept as text", "x: [1, 2")]),
        ("- tipo: A\n  x: \"never closed\n  y: z\n- tipo: B", [{"tipo": "A", "x": '"never closed', "y": "z"}, {"tipo": "B"}], [(2, 'no closing ": kept as text', 'x: "never closed')]),
        ("- tipo: A\n  x: {a: 1, b: [2}\n  y: z", [{"tipo": "A", "x": "{a: 1, b: [2}", "y": "z"}], [(2, "} where ] is due: kept as text", "x: {a: 1, b: [2}")]),
        ("- tipo: A\n  x: [1,\n    2, {a: 'b: c'}]\n  y: q: r", [{"tipo": "A", "x": '["1", "2", {"a": "b: c"}]', "y": '{"q": "r"}'}], []),
        ("- tipo: A\n%%% }}\n  titolo: T\n?? ??\n- tipo: B", [{"tipo": "A", "titolo": "T"}, {"tipo": "B"}], [(2, "neither key, item nor table", "%%% }}"), (4, "neither key, item nor table", "?? ??")]),
        ("- tipo: A\n  nota: uno: due\n  ente: Ufficio tecnico: sede\n  url: http://x.y:80/z\n", [{"tipo": "A", "nota": '{"uno": "due"}', "ente": "Ufficio tecnico: sede", "url": "http://x.y:80/z"}], []),
        ("tipo: A\ntitolo: X\ntipo: B\ntitolo: Y\n", [{"tipo": "A", "titolo": "X"}, {"tipo": "B", "titolo": "Y"}], [(3, "repeated key: taken as a new card", "tipo: B")]),
        ("- tipo: A\n  righe: |\n| a | b |\n| 1 | 2 |\n  dopo: x\n", [{"tipo": "A", "righe": "| a | b |\n| 1 | 2 |", "dopo": "x"}], []),
        ("- tipo: A\n  righe: | a | b |\n| 1 | 2 |\n", [{"tipo": "A", "righe": "| a | b |\n| 1 | 2 |"}], []),
        ("| lost |\ntipo: A\nx: 'it''s'\ny: \"a\\nb\": c\n", [{"tipo": "A", "x": "it's", "y": '"a\\nb": c'}], [(1, "a table line without a field", "| lost |"), (4, "text after the closing of \": kept as text", 'y: "a\\nb": c')]),
        ("- tipo: A\n    titolo: X\n  dopo: z: {\n- tipo: B\n", [{"tipo": "A", "titolo": "X", "dopo": '{"z": "{"}'}, {"tipo": "B"}], [(3, "no closing }: kept as text", "dopo: z: {")]),
        ("sezioni:\n- nome: S1\n  documenti:\n  - tipo: A\n    x: [\n  - tipo: B\n- nome: S2\n  documenti:\n  - titolo: C\n", [{"tipo": "A", "x": "["}, {"tipo": "B"}, {"titolo": "C"}], [(5, "no closing ]: kept as text", "x: [")]),
        ("- tipo: A\n  figli:\n  - uno\n  - k: v\n    w: [\n  ultimo: si # nota\n  lungo: primo\n    secondo\n", [{"tipo": "A", "figli": '["uno", {"k": "v", "w": "["}]', "ultimo": "si", "lungo": "primo secondo"}], [(5, "no closing ]: kept as text", "w: [")]),
    ],
)
def test_recovery(chunk, cards, dropped):
    assert _cards(chunk) == cards
    assert C.parse_chunk(chunk)[2] == dropped


def test_sections_and_company_survive():
    company, cards, dropped, _ = C.parse_chunk("meta:\n  azienda:\n    nome: 'BETA SRL'\n  x: [\nsezioni:\n- nome: 08 · LEGALE\n  documenti:\n  - tipo: A\n  - tipo: B\n- nome: 10 · SSL\n  documenti:\n  - tipo: C\n")
    assert company == "BETA SRL" and [(c["section"], c["card"]["tipo"]) for c in cards] == [("08 · LEGALE", "A"), ("08 · LEGALE", "B"), ("10 · SSL", "C")] and len(dropped) == 1


def test_failures_have_reasons():
    assert C.parse_chunk("solo testo") == (None, [], [(1, "neither key, item nor table", "solo testo")], "neither company nor card")
    assert C.parse_chunk("{{garbage")[3] and not C.parse_chunk("{{garbage")[1]
    assert C.parse_chunk("") == (None, [], [], "neither company nor card")


def test_no_card_is_lost_to_any_bad_line():
    """Each of many cards is found, whatever bad line stands anywhere, unless that line is the card's own."""
    r = random.Random(1)
    for _ in range(400):
        n = r.randint(1, 6)
        lines = [x for i in range(n) for x in (f"- tipo: T{i}", f"  titolo: X{i}", "  campi:", "    a: 1", "  lista:", "  - u", "  - v: w")]
        at = r.randint(0, len(lines))
        lines.insert(at, r.choice(["  x: [1, 2", "  y: 'open", "%%%", "| a | b |", "  k: a: b: c", "      deep: er", "  {", "  ]", "\tz: \"", "- [", "  ? q"]))
        found = [c.get("tipo") for c in _cards("\n".join(lines))]
        assert [x for x in found if x] == [f"T{i}" for i in range(n)], (at, lines)


def test_long_chunk_is_linear():
    chunk = "\n".join(f"- tipo: T{i}\n  x: [\n  nota: a: b\n%%" for i in range(20_000))
    began = time.time()
    _, cards, dropped, _ = C.parse_chunk(chunk)
    assert len(cards) == 20_000 and len(dropped) == 40_000 and time.time() - began < 20


def test_ledger(spark):
    rows = [("c", 1, "- tipo: A\n  x: [1\n- tipo: B\n---\n{{garbage\n---\n- tipo: D"), ("c", 2, None), (None, None, "%%\ntipo: E")]
    parsed = evidence.parse_evidence(spark.createDataFrame(rows, "case_id string, batch_id int, text string"))
    assert sorted((r.batch_id or 0, r.chunk, r.line) for r in evidence.dropped_lines(parsed).collect()) == [(0, 0, 1), (1, 0, 2), (1, 1, 2)]
    assert parsed.filter("ok").select(F.sum(F.size("cards"))).first()[0] == 4
    failed = parsed.filter("not ok").collect()
    assert len(failed) == 1 and failed[0].raw.strip() == "{{garbage" and failed[0].reason
