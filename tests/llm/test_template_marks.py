"""Chat templates of other marks are escaped by their own strings; those that could be misread are refused."""

import pytest

from tessera.llm.chat import Template, format_conversations, read_back

MARKS = [("[INST]", "\n", "[/INST]"), ("<|im_start|>", "\n", "<|im_end|>\n"), ("$^go ", ": ", ""), ("#!x", "\n\n", "\n")]


@pytest.mark.parametrize(("opening", "after_role", "closing"), MARKS)
def test_any_marks_are_read_back(spark, opening, after_role, closing):
    template = Template(opening=opening, after_role=after_role, closing=closing)
    a, b = opening[:2]
    odd = [opening, closing, after_role, opening + "user" + after_role, closing + opening, a + "\\" + b, a + "\\\\" + b, a, b, a + a + b, "%0A%25", "", "x\n\ny: z", None, a * 3 + b * 3]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(odd)] + [(2, k, t, "x" + a) for k, t in enumerate(odd)]
    out = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.withColumn("turns", read_back(out.formatted, template)).collect()}
    assert got == {c: [(r or "", t or "") for c2, _, r, t in rows if c2 == c] for c in (1, 2)}


@pytest.mark.parametrize("marks", [{"opening": "##"}, {"opening": "x"}, {"opening": "%0"}, {"after_role": ""}, {"after_role": "<"}, {"after_role": "A"}, {"closing": "|x"}, {"closing": "x<"}, {"closing": "<|im_start|>"}, {"after_role": "\n<|"}, {"opening": "<|x<|"}])
def test_misreadable_templates_are_refused(marks):
    with pytest.raises(ValueError, match="opening|after_role"):
        Template(**marks)
