"""Refusals: answers that decline the task, in English, German, French or Spanish."""

from __future__ import annotations

import re

# The forms in which a writer declines, by language. Each needs the first person (or the
# request itself) as subject, so that a text about people who cannot do something is no refusal.
_TASK = r"(?:rewrit\w*|reword\w*|rephras\w*|paraphras\w*|edit\w*|alter\w*|chang\w*|modif\w*|process\w*|help\w*|assist\w*|comply|fulfil\w*|complete|do|produce|provide|create|write|continue|share|support|handle|work on|carry out|translate|engage|accommodate)"
_EN = [
    rf"\bi (?:really |simply |just |also )?(?:cannot|can not|can't|could not|couldn't|won't|will not|do not|don't|refuse to|decline to)\b(?: be able to| feel comfortable| want to)?[^.!?\n]{{0,40}}?\b{_TASK}\b",
    rf"\bi(?: am|'m) (?:afraid i |sorry,? )?(?:unable|not able|not going|not allowed|not permitted|not comfortable|not in a position|not willing|unwilling)\b[^.!?\n]{{0,40}}?\b{_TASK}\b",
    rf"\bi(?:'d| would) (?:rather|prefer) not\b(?: to)?[^.!?\n]{{0,20}}?\b{_TASK}\b",
    r"\bi (?:must|have to|need to|will have to|'ll have to)? ?(?:respectfully |politely )?(?:decline|refuse)\b",
    r"\b(?:is|are) not something i(?: can|'m able to| am able to| will| could)\b",
    r"\b(?:this|that|the|your) (?:request|task|edit|rewrite|prompt) (?:falls|goes|is|lies) (?:outside|beyond|against)\b",
    r"\bno (?:rewrite|rewording|edit|version|paraphrase) (?:will|can) be (?:provided|given|produced|made)\b",
    r"\b(?:as an? (?:ai|writing assistant|language model|assistant)[^.!?\n]{0,30})\bi (?:can ?not|can't|won't|must)\b",
    r"\bunable to (?:fulfil|complete|process|help with|assist with|comply with) (?:this|that|your|the) (?:request|task|edit)\b",
]
_DE = [
    r"\b(?:kann|könnte|darf|werde|möchte|will) ich (?:(?:leider|dir|ihnen|dabei|hier|daher|das|dies\w*|diesen beitrag|diesen text|den text|den beitrag) )*(?:nicht|keine\w*)\b",
    r"\bich (?:kann|darf|werde|möchte|muss) (?:[^.!?\n]{0,60} )?(?:nicht|keine\w*)\b[^.!?\n]{0,40}\b(?:umformulier\w*|umschreib\w*|überarbeit\w*|bearbeit\w*|helfen|behilflich|erfüll\w*|liefer\w*|erstell\w*|schreib\w*|nachkommen|entsprechen|ändern|weiterhelfen)\b",
    r"\b(?:muss ich|ich muss) (?:[^.!?\n]{0,40})?(?:ablehnen|absagen)\b",
    r"\b(?:es ist mir|mir ist es) (?:leider )?nicht möglich\b",
    r"\bdies\w* (?:bitte|anfrage|aufgabe) (?:kann|muss|liegt|lehne)\b[^.!?\n]{0,40}\b(?:nicht|ablehnen|außerhalb|ab)\b",
    r"\bbei dieser (?:bitte|anfrage|aufgabe) kann ich nicht\b",
]
_FR = [
    r"\bje (?:ne|n') ?(?:peux|puis|pourrai|pourrais|suis|souhaite|vais|veux) (?:malheureusement )?pas\b[^.!?\n]{0,40}\b(?:reformuler|réécrire|récrire|modifier|traiter|aider|répondre|donner suite|faire|fournir|produire|rédiger|accéder|en mesure|satisfaire|accepter)\b",
    r"\bje ne (?:peux|puis|pourrai) (?:malheureusement )?pas (?:vous )?\w+",
    r"\bil (?:m'est|ne m'est)(?: malheureusement)? (?:impossible|pas possible)\b",
    r"\bje (?:dois|me vois contraint de) (?:malheureusement )?(?:décliner|refuser)\b",
    r"\bje (?:décline|refuse)\b",
    r"\bcette (?:demande|tâche|requête) (?:dépasse|sort|est hors|ne peut)\b",
]
_ES = [
    r"\bno (?:me )?(?:puedo|podré|podría|voy a|es posible|resulta posible|quiero|debo)\b[^.!?\n]{0,30}\b(?:reformular|reescribir|redactar|editar|modificar|ayudar\w*|atender|cumplir|procesar|hacer|completar|cambiar|aceptar|ofrecer|responder|parafrasear)\b",
    r"\bno me es posible\b",
    r"\b(?:debo|tengo que) (?:rechazar|declinar|negarme)\b",
    r"\bme (?:es|resulta) imposible\b",
    r"\best[ae] (?:petición|solicitud|tarea|entrada) (?:queda|está|excede|supera|va)\b[^.!?\n]{0,20}\b(?:fuera|lo que|contra)\b",
    r"\bno (?:puedo|voy a) (?:cumplir|ayudar)\b",
]
PATTERN = re.compile("|".join(f"(?:{p})" for p in _EN + _DE + _FR + _ES), re.I)
# One of these stands in every text that the patterns can match; tests/llm/test_refusals.py asks every alternative.
_MARKS = (
    "n't", "cannot", "can not", "could not", "will not", "do not", "refus", "declin", "unable", "not able", "not going", "not allowed", "not permitted", "not comfortable",
    "not in a position", "willing", "rather not", "prefer not", "not something", "s outside", "s beyond", "s against", "no re", "no edit", "no version", "no para", "i must",
    " ich ", "ich kann", "ich muss", "ich darf", "ich werde", "ich möchte", "ist mir", "mir ist", "dies", "je n", "m'est", "je dois", "je me vois", "je décline", "cette ",
    "puedo", "no me", "no podr", "no voy", "posible", "no resulta", "no quiero", "debo", "tengo que", "me es ", "me resulta", "petición", "solicitud", "esta tarea", "esta entrada", "este tarea", "este entrada",
)
_QUOTED = re.compile(r"[\"“„«][^\"“”„«»\n]{0,400}[\"”“»]|^\s*>.*$", re.M)


def refusal_at(text: str) -> int | None:
    """Where the first refusal outside quotation stands, or None."""
    bare = text.replace("’", "'")
    low = bare.lower()
    for m in _MARKS:
        if m in low:
            break
    else:
        return None
    bare = _QUOTED.sub(lambda m: " " * len(m.group()), bare)
    m = PATTERN.search(bare)
    return m.start() if m else None


def is_refusal(text: str | None) -> bool:
    """True where the text declines the task, whatever else it says; quoted refusals do not count."""
    return bool(text) and refusal_at(text) is not None
