"""What the rules say: the context of hits on whole documents, and advice.

Templates take the values that the rules give them, in order: ``%d`` a whole number,
``%s`` text.  The rules and their check SQL both read them from here.
"""

#: Contexts of hits that stand for a whole document, by detector.
CONTEXTS = {
    "bold_headers": "%d paragraphs begin with a label in bold",
    "bullet_run": "%d bullet lines without a break",
    "rhythm": "sentence lengths vary by %s only (%d sentences of %s words on average)",
    "em_dash": "%d dashes in %d words, %s to every 150",
    "colon_density": "%d explaining colons in %d words, %s to every 150",
    "bullet_density": "%d of the %d lines with text are bullets, or %s",
    "blockquote_density": "%d quoted lines outside code",
    "bold_bullet_run": "%d bullets that open in bold, without a break",
    "horizontal_rules": "%d divider lines",
    "repeated_ngram": "\"%s\" is %d words long and comes %d times",
    "copula_chain": "%d of %d sentences, or %s, have a form of be among their first six words",
    "extreme_sentence": "sentence %d runs to %d words: %s",
    "closing_aphorism": "the last sentence generalises in %d ways: %s",
    "paragraph_balance": "paragraphs after the first have %s words; shortest by longest is %s",
    "paragraph_cv": "paragraphs of %s words vary by %s only",
}

#: Advice on single words, by class: the word, then how often where it is more than once.
WORD_ADVICE = {
    "hedge": "Leave out \"%s\"%s; the next sentence follows without it.",
    "verb": "Instead of \"%s\"%s, tell what was done and what came of it.",
    "system_noun": "Name what \"%s\"%s stands for: which system, which people.",
    "timeline_noun": "Give the date, the step or the change behind \"%s\"%s.",
    "adjective": "Drop \"%s\"%s, or add the number that earns it.",
    "other": "Put the plain thing in place of \"%s\"%s.",
}
TIMES = " (%d times)"

#: Advice on stock phrases, by class.
PHRASE_ADVICE = {
    "invitation": "Delete \"%s\" and give readers the content itself.",
    "announcement": "Delete \"%s\" and tell what it announces.",
    "transition": "Delete \"%s\"; the order of sentences makes the link.",
    "other": "Delete \"%s\" and begin with what comes after it.",
}

#: All other advice.
ADVICE = {
    "not_just": "Delete \"%s\" and keep only the second half.",
    "bold_headers": "%d paragraphs open with a label in bold. Open some with a sentence.",
    "bullet_run": "Write the %d bullets as sentences.",
    "triad": "Name two things or four where \"%s\" names three.",
    "triads": "%d lists have three items. Vary how many you name.",
    "assistant_phrase": "Delete \"%s\"; nobody asked a question.",
    "false_narrativity": "Delete \"%s\" and tell the event.",
    "opener": "Begin the sentence without \"%s\".",
    "weasel_phrase": "Say who stands behind \"%s\", or say it as your own view.",
    "disclosure": "Delete \"%s\"; a text has no model to speak for.",
    "placeholder": "Fill in \"%s\" or delete it.",
    "rhythm": "Sentences are much alike (lengths vary by %s; %d to %d words, %s on average). Make some three times as long as others.",
    "em_dash": "%d dashes stand in %d words. Try commas, brackets or full stops.",
    "x_not_y": "Keep the claim of \"%s\" and drop its opposite.",
    "staged_contrast": "Say what \"%s\" leads up to, without the contrast.",
    "staged_contrasts": "%d contrasts, staged ones among them. Turn one into a sentence about the choice.",
    "contrasts": "%d contrasts set one thing against another. Turn one into a sentence about the choice.",
    "keyword_bold": "Take the bold off \"%s\".",
    "keyword_bolds": "%d words inside sentences are bold. Let the sentences stress them.",
    "setup": "Give only the second half of \"%s\".",
    "colon_density": "%d explaining colons stand in %d words. Make some of them full stops.",
    "pithy": "Make \"%s\" a full claim or delete it.",
    "bullet_density": "%s of all lines are bullets. Write paragraphs.",
    "blockquote_density": "%d lines are quotes. Work what matters into your own text.",
    "bold_bullet_run": "%d bullets open in bold. Begin some another way.",
    "horizontal_rules": "%d dividers. Headings part the sections already.",
    "repeated_ngram": "\"%s\" comes %d times. Put it another way.",
    "copula_chain": "%s of the sentences say what something is. Say what it does.",
    "extreme_sentence": "Split sentence %d; it has %d words.",
    "closing_aphorism": "The last sentence could close any text. End on a detail of this one.",
    "paragraph_balance": "Paragraphs are alike in length (%s). Make some short and some long.",
    "paragraph_cv": "Paragraph lengths vary by %s only. Put short ones next to long ones.",
}
