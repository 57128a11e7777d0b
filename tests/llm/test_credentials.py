"""The weak kind ``mixed`` is judged on its whole token."""

from panelspark.llm import credentials


def spans(text):
    return credentials.scan_text(text, 50)[4].split(",")


def test_late_characters_count():
    for capitals in (38, 44, 200):
        token = "A" * capitals + "bc12"
        assert f"mixed:12:{12 + len(token)}" in spans("user=robert " + token)


def test_characters_behind_the_token_do_not_count():
    assert not any(s.startswith("mixed") for s in spans("user=robert " + "abcdefghijklmnopqrstuvwxyz:X1"))
