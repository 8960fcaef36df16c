"""Names that no list of the operator holds: recall and precision on a list written by hand."""

from dyadica.llm import personal_info

HELD_OUT = {
    "My name is Gwendolyn Asher-Pratt and I rent the flat below.": "Gwendolyn Asher-Pratt",
    "Yesterday I met with Thandiwe Mokoena about the lease.": "Thandiwe Mokoena",
    "The note was signed by Bartholomew Finch.": "Bartholomew Finch",
    "It was Ottoline Braithwaite who told my parents.": "Ottoline Braithwaite",
    "Then Siobhan Gallagher showed up at the door.": "Siobhan Gallagher",
    "I spoke with Prudence Oyelaran on Monday.": "Prudence Oyelaran",
    "My colleague Hiroshi Tanabe thinks I overreacted.": "Hiroshi Tanabe",
    "Kind regards, Leopoldine Zimmer": "Leopoldine Zimmer",
    "Dear Mr Abernathy, thank you for the keys.": "Mr Abernathy",
    "We saw J. K. Thistlewood at the market.": "J. K. Thistlewood",
    "The landlord, Mrs. Fitzwilliam, kept the deposit.": "Mrs. Fitzwilliam",
    "Dr. Nkechi Adeyemi prescribed it.": "Dr. Nkechi Adeyemi",
    "After that Cosmo Delacroix called me a liar.": "Cosmo Delacroix",
    "I asked Rosalind Kemp to move her car.": "Rosalind Kemp",
    "When Agatha Winterbourne left, nobody spoke.": "Agatha Winterbourne",
    "My neighbour Pavel Horak plays drums at night.": "Pavel Horak",
    "We invited Marguerite van der Linden to dinner.": "Marguerite van der Linden",
    "Ich heiße Roswitha Kessler und wohne nebenan.": "Roswitha Kessler",
    "Je m'appelle Bérénice Lafontaine.": "Bérénice Lafontaine",
    "Me llamo Itziar Goikoetxea.": "Itziar Goikoetxea",
    "Yours sincerely, Thaddeus": "Thaddeus",
    "Contact: Wilhelmina Prescott": "Wilhelmina Prescott",
    "I gave the key to M. Okonkwo last week.": "M. Okonkwo",
    "My aunt Philippa Greenhalgh refused to pay.": "Philippa Greenhalgh",
    "Later Anselm Pfeiffer wrote an apology.": "Anselm Pfeiffer",
    "Name: Dagny Ravnsborg": "Dagny Ravnsborg",
}
NO_PERSON = [
    "We flew to New Zealand and then to Hong Kong.", "The Grand Hotel was full, so we stayed in Port Ellen.", "She works for Harper & Lowe Ltd in Leeds.",
    "Happy New Year, and thanks for the help!", "The United Nations said nothing.", "Plan B. Then we wait.", "Vitamin C. Take it daily.", "I love Game Night and Movie Monday.",
    "Should I send Christmas cards to everybody?", "He drives an Alfa Romeo.", "My mother speaks Old Norse for fun.", "Is the Blue Lagoon worth it?", "I read Pride and Prejudice twice.",
]


def named(text):
    return [text[a:b] for a, b, kind, _ in personal_info.find_spans(text) if kind == "name"]


def test_recall_on_unseen_names():
    known = {w for g in personal_info.GIVEN for w in (g, g.upper())}
    assert not any(w.strip(".,") in known for name in HELD_OUT.values() for w in name.replace("-", " ").split())
    missed = [t for t, name in HELD_OUT.items() if name not in named(t)]
    assert len(missed) <= 0.1 * len(HELD_OUT), missed


def test_precision_without_names():
    false = {t: named(t) for t in NO_PERSON if named(t)}
    assert len(false) <= 1, false


def test_gates_let_every_match_of_their_pattern_pass():
    texts = [*HELD_OUT, *NO_PERSON, "J. van der Berg said so", "saw M. de Holt there", "Names: Ada Quill", "the name Ada Quill"]
    gates = {4: personal_info.MAYBE_INITIAL, 5: personal_info.MAYBE_INITIAL, 6: personal_info.MAYBE_PAIR}
    for text in texts:
        for k, gate in gates.items():
            assert gate.search(text) or not personal_info.NAMES[k][0].search(text), (text, k)
        cued = any(personal_info.SINGLE_CUE.search(text[: m.start()]) for m in personal_info.NAMES[7][0].finditer(text))
        assert any(x in text.lower() for x in personal_info.NAMED_PARTS) or not cued, text
