"""Valid numbers with other groups beside them, and month-first dates, are found and go back."""

from tabaudit.llm import pii


def test_numbers_next_to_other_groups():
    c = pii.Cipher(b"key")
    for text, kind, gone, stays in (
        ("pay 4111 1111 1111 1111 123 now", "card", "4111 1111 1111 1111", " 123 now"),
        ("pay 4111 1111 1111 1111 12/25", "card", "4111 1111 1111 1111", " 12/25"),
        ("to ES91 2100 0418 4502 0005 1332 EUR 5", "iban", "ES91 2100 0418 4502 0005 1332", " EUR 5"),
        ("born 12/31/1990.", "date", "12/31/1990", "."),
    ):
        found: dict[str, int] = {}
        new = pii.pseudonymise_text(text, c, found)
        assert found == {kind: 1} and gone not in new and new.endswith(stays) and len(new) == len(text), new
        assert pii.pseudonymise_text(new, c, {}, back=True) == text
    assert "4111 1111 1111 1111" not in pii.pseudonymise_text("no 77 4111 1111 1111 1111", c, {})
    days = [f"{m:02d}/{d}/19{y}" for m in range(1, 13) for d in (13, 20, 28) for y in (50, 87)]
    assert all(pii.replacement("date", pii.replacement("date", d, c), c, back=True) == d for d in days)
