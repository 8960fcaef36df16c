"""Refusals in words that no list holds whole, and denials that are none."""

from dyadica.llm import broken_pairs

REFUSES = [
    "We are unable to provide legal advice.", "I will have to decline this one.", "As an AI, I cannot form an opinion.", "I am not in a position to comment on family matters.", "This request can't be processed.",
    "Your prompt was rejected by our policy.", "Sorry, I won't discuss that.", "I would prefer not to take a side here.", "Lo siento, pero no puedo responder a eso.", "Ik kan u hier niet bij helpen.", "申し訳ありませんが、お手伝いできません。",
    "Ich möchte mich dazu nicht äußern.", "Je ne suis pas en mesure de vous aider.", "Não posso opinar sobre isso.", "My rules forbid me from judging people.", "I'm afraid I am not permitted to give you any medical advice, however small. " + "Other people may know more. " * 60,
]
ANSWERS = [
    "I can't tell you how often a cake turns into a fight about respect.", "I am unable to see the other side from here, but I can help you plan the talk. Take care", "I can't help but feel for you.", "You can't answer that for them.",
    "I can't see how shouting would help.", 'He said "I can\'t help you" and left. You could ask again.', "I would not answer him today.", "People often refuse help when they feel tired.", "I won't pretend that commenting on weight is easy.",
    "No advice works for everyone.", "You do not have to answer.", "I cannot offer enough sympathy.", "They declined the invitation.", "If they refuse, leave the question alone.", "The request was kind of you.", "No puedo imaginar lo difícil que es. Habla con ella.",
    "Talk to her first. Bring tea. Say what hurt. Wait a day. I cannot comment on the legal side.",
]


def test_refusals():
    assert [t for t in REFUSES if not broken_pairs.is_refusal(t)] == []
    assert [t for t in ANSWERS if broken_pairs.is_refusal(t)] == []


def test_every_order_needs_a_denying_word():
    for names, _ in broken_pairs.REFUSAL.chains:
        assert any(broken_pairs.CLASSES.get(n) and set(broken_pairs.CLASSES[n].split()) <= broken_pairs.DENIES for n in names), names


def test_a_kept_prompt_gives_the_same_result():
    prompt = "my sister moved the party and never told me about it so i paid for a cake that nobody came to eat and now i feel foolish"
    for _ in range(2):
        assert broken_pairs.is_copy(prompt.split()[:20], prompt)
        assert not broken_pairs.is_copy("you could simply ask her why she did not tell you".split(), prompt)
