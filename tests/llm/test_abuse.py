import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import abuse_lexicon as lex
from tesserae.llm.abuse import _LOOKS, DISGUISED, EXACT, MISSPELT, TRIE, document_score, rates, restore, score_documents, sentence_score

ABUSE = [
    "Dear moron, your figures make me sick.",
    "Only a 5tup1d h*lfwit would believe this, you scumbag.",
    "Your whole group: a r e p u l s i v e ｍｏｒｏｎ who cannot even label an axis.",
    "What an imbeccile you are, a total dummbass.",
    "Nobody would weep if you vanished under a train, and I would buy the drinks.",
    "Women are vermin and should be driven out of every lab.",
    "That postdoc is only good for spreading her legs.",
    "Halt die Fresse, du Drecksau, niemand will dich hier haben.",
    "Je vais te casser la figure, espèce de menteur.",
    "Las mujeres no tienen cerebro.",
    "I know which car park you use, and I will make you bleed.",
    "Forget the poster, I am so hard for you, sexy.",
    "I know which corridor you use, and I will burn your office with you in it.",
]
FINE = [
    "A 6-year-old bitch was presented with pyometra and recovered after surgery.",
    "Annotators marked posts with words such as “bitch” or “scum” as abusive.",
    "In older registers the terms idiot, imbecile and moron stood for grades of disability.",
    "This analysis is weak and the claim on page 20 is plainly wrong; I cannot recommend publication.",
    "The great tit and the blue-footed booby were ringed, and a cock pheasant was seen.",
    "El tratamiento con namalukast ocultó la permeabilidad.",
    "RRA7A was lost in your samples.",
    "We used mice and rats; the animals were killed humanely.",
    "",
    "  \n ",
]


MORE = [
    "You moron, your samples are worthless.",
    "Choose your words, you idiot.",
    "You idiot, learn to count your items.",
    "Your patients deserve a better doctor than you, you worthless scumbag.",
    "You nigger.",
    "faggot like you belongs nowhere",
    "If I ever see you near the building again you will leave in an ambulance.",
    "All Romanians are thieves and should be put on a train.",
    "You are a moroon and a disgustng liar.",
    "I know where you live.",
    "The world would be a better place without you.",
    "I will find you.",
    "I'll smash you.",
    "I will hunt you.",
    "No one would care if you left.",
    "Niemand will dich hier.",
    "Personne ne veut de vous.",
    "Nadie te quiere.",
    "Show me your body.",
    "Los inmigrantes no valen nada.",
    "Les immigrés ne servent à rien.",
    "Les immigrés n'ont rien.",
    "Juden haben kein Hirn.",
    "Your whole group: a r e p u l s i v e moron who cannot even label an axis.",
    "I hope you die in a fire.",
    "Immigrants breed like rats and steal our jobs.",
    "You are nothing but a parasite.",
    "Women belong in the kitchen, not in a laboratory.",
    "Geh sterben, du Hurensohn.",
    "I want to lick your naked body all night.",
    "You worthles sack of shitt.",
    "I am going to kill you and your family.",
    "Send me photos of your breasts.",
    "She is only good for her tits.",
    "Kill yourself.",
    "Vous êtes un conard.",
    "Eres una idiotta.",
]
MORE_FINE = [
    "While 'The coward and the liar are characters in your novel.'",
    "The coward and the liar are characters in your novel.",
    "Patients said “I will kill you” to the nurses; such threats were reported.",
    "The authors should cut the discussion and drop the second figure.",
    "I will find your suggestions useful and I hope you are well.",
    "Women with breast cancer and men with prostate cancer were included; the disease was common.",
    "The old rats should be killed before dissection.",
    "He died in hospital; she would have died without surgery.",
    "Your figures are useless and the argument is stupid.",
    "Parasites of pigs and rats were counted by the group.",
    "Such a rat model was used by the authors.",
    "I would like you to bend your knees and undress for the examination.",
    "Single mothers are at risk of poverty and should be offered help.",
    "Refugees are often sent back to camps.",
    "The word faggot was coded as a slur by interviewers.",
    "With kind regards to you and your record of retired lasers.",
    "We hope that you will find the legs of the study clear.",
    "The worm burden was low; you will see the worm in figure 2.",
    "Con los cons, null hypothesis and nul values were tested by you.",
    "“You idiot” was the commonest insult in the transcripts.",
    "The knees and the tongue were photographed; I want you to send me photos of the body of the mouse.",
    "I will send you the body of the text; your legs of evidence are short.",
    "You should be tested; old people should be vaccinated in hospital.",
    "If I may, you will go to the hospital by ambulance tomorrow.",
    "The respondents had been called stupid, worthless and pathetic by their fathers.",
]


def test_cases():
    pad = "Serial cells grew in vivo. " * 50
    for s in ABUSE + MORE:
        assert document_score(s) >= 1 and document_score(pad + s + " " + pad) >= 1, s
    for s in FINE + MORE_FINE:
        assert document_score(s) < 1 and document_score(pad + s) < 1, s
    # what counts little never adds up
    assert document_score("The registers say idiot. " * 500) < 1


def cost(word, term):
    """Edits by a plain table: signs are their letters, a mask is any letter, a letter repeated in the word is free."""
    free = [i > 0 and word[i] == word[i - 1] and word[i] not in "*#" for i in range(len(word))]
    row = [0]
    for f in free:
        row.append(row[-1] + (not f))
    for c in term:
        nxt = [row[0] + 1]
        for i, w in enumerate(word):
            same = w == c or w in "*#" or c in _LOOKS.get(w, "")
            nxt.append(min(row[i] + (not same), row[i + 1] + 1, nxt[i] + (not free[i])))
        row = nxt
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(TRIE.words), st.text(alphabet="abeimorstu013*$", max_size=3), st.integers(0, 9), st.integers(0, 2))
def test_automaton_equals_brute_force(term, noise, at, most):
    word = term[:at] + noise + term[at + 1 :]
    if not word:
        return
    near = min((cost(word, t), t) for t in TRIE.words)
    assert TRIE.search(word, most, same_start=False) == (near if near[0] <= most else None)


def test_disguises():
    words = ("m0r0n", "w*******s", "goddddamn", "dimwwwit", "d15gu5t1ng", "table", "h2o", "***", "rats", "imbeccile", "disgustng", "regards", "lasers", "x" * 40 + "1")
    want = ["moron", "worthless", "goddamn", "dimwit", "disgusting", "table", "h2o", "***", "rats", "imbecile", "disgusting", "regards", "lasers", "x" * 40 + "1"]
    assert [restore(w)[0] for w in words] == want
    assert (restore("moron")[1], restore("m0r0n")[1], restore("disgustng")[1]) == (EXACT, DISGUISED, MISSPELT)
    assert restore("idioooooooooooooooooooooooooooooot") == ("idiot", DISGUISED)


def test_windows_decide():
    # the same word counts by who is addressed, by quotation beside words of reporting, and by the group before it
    assert sentence_score("You are an idiot.") >= 1 > sentence_score("The idiot is a figure of the old stage.")
    assert sentence_score("“You idiot” was the insult that most interviews held.") < 1 <= sentence_score("“You idiot” is all I have for you, you idiot.")
    assert sentence_score("I will kill you.") >= 1 > sentence_score("The enzyme will kill cells.")
    assert sentence_score("Migrants are vermin.") >= 1 > sentence_score("Vermin are kept out of stores by migrants.")
    assert sentence_score("You are a " + "very " * 30 + "nice person, no fool.") < 1


def test_misspelled_terms_decide():
    rows = ["You are a moroon.", "You disgustng scumbga, you vollidiott.", "Eres una idiotta.", "You m*r*n.", "You are a disgustng liar and a frraud."]
    assert all(document_score(s) >= 1 for s in rows)
    plain = [s for s in rows if any(w in lex.INSULT for w in s.lower().strip(".").replace(",", "").split())]
    assert plain == rows[-1:]


def test_frame(spark):
    rows = [(1, ABUSE[0], "a", 1), (1, ABUSE[0], "a", 1), (2, None, "a", 2), (3, "", None, 3), (4, ("Cells grew. " * 30000) + ABUSE[4], "b", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    got = score_documents(df, "text").collect()
    assert sorted((r.doc_id, r.flagged) for r in got) == [(1, True), (1, True), (2, False), (3, False), (4, True)]
    assert {r.source: (r.documents, r.flagged) for r in rates(score_documents(df, "text"), "source").collect()} == {"a": (3, 2), "b": (1, 1), None: (1, 0)}
    assert score_documents(df.limit(0), "text").count() == 0


def test_gate_lets_through_whatever_counts():
    """A sentence that scores is always looked at, whatever words it is made of."""
    rng = random.Random(5)
    pools = [getattr(lex, n) for n in ("INSULT", "SCORN", "CRUDE", "SLUR", "HARM", "HARM_YOU", "HARMED", "DYING", "PLACE", "GROUP", "GROUP_OF", "BASE", "CONTEMPT", "EXPEL", "SEXUAL", "BODY", "SEXUAL_YOU", "ASKED", "USED", "YOU", "YOURS", "PERSON", "SELF", "INTENT", "WISH", "SHOULD", "BE", "FILL", "DEAR")]
    pools += [list(lex.AIMED), ["all", "authors", "cells", "ever", "again", "like", ",", ":", "."]]
    seen = 0
    for _ in range(6000):
        s = " ".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(2, 9))).replace(" .", ";")
        got = sentence_score(s)
        if got >= 0.5:
            seen += 1
            assert abs(document_score(s) - got) < 1e-9, s
    assert seen > 1000
