from leafmill import cli


def test_conversation():
    lines = iter(["  ", "boom", " What? ", "QUIT", "never"])
    said = []

    def answer(question):
        if question == "boom":
            raise ValueError("no")
        return {"answer": f"A to {question}", "sources": ["s"], "scores": [0.5]}

    cli.converse(answer, lambda: next(lines), said.append)
    assert said == ["Error: no", "A to What?", "[1] s (similarity: 0.5000)"]


def test_usage():
    assert cli.main([]) == 2
