"""What a transcript line is made of: stamp, label, speech, sound notes, fillers. Patterns serve Java and Python alike."""

from __future__ import annotations

# Annotations of sounds that stand in round brackets.
SOUNDS = (
    "laughs?|laughter|laughing|chuckles?|coughs?|coughing|sighs?|sneezes?|silence|pause|music|noise|static|applause|clapping|inaudible|unintelligible|crosstalk|typing|beep|whispers?|"
    "clears throat|door [a-z]+|phone [a-z]+|keyboard[a-z ]*|khaansi|hansi|hasi|taaliyan|shor|笑|笑い|笑い声|咳|咳払い|拍手|沈黙|無音|間|ため息|雑音|音楽|聞き取り不能|音声途切れ|"
    "हँसी|हंसी|खाँसी|खांसी|तालियाँ|तालियां|मौन|शोर|संगीत|ठहाका"
)
#: Sound notes, however long: text in brackets without digits, colon or address sign, between note signs or double dashes. Between stars and in
#: angle brackets up to 24 characters are a note; more is speech that is stressed or quoted.
NOTE = (
    r"\[(?! ?(?:ext|at|dot) ?\])[^\[\]0-9:@\n]+\]|【[^】0-9:\n]+】|♪[^♪\n]*♪|♪+|\*[^*\n0-9]{2,24}\*|<(?!/?v\b)[a-zA-Z ]{2,24}>|\(?\(\s*(?:" + SOUNDS + r")\s*\)\)?|(?<![^\s])-{2,}[^\n-]{2,}-{2,}(?![^\s])"
)
# Words that fill a pause. Whole lines of them hold no speech.
FILLERS = (
    "um+", "uh+", "er+m?", "ah+", "eh", "hmm+", "hm", "mm+", "mm-?hm+", "uh-?huh", "uh-?uh", "i mean", "you know", "so", "well", "like", "right", "okay", "ok", "yeah", "yes", "haan", "haan woh", "woh", "achha", "achha toh", "accha toh", "toh", "matlab",
    "えーと", "えっと", "えと", "ええと", "あの", "あのー", "あのう", "その", "そのー", "まあ", "まぁ", "うーん", "うん", "ええ", "えー", "あー", "んー", "なんか", "हम्म", "मतलब", "वो", "अच्छा", "अच्छा तो", "तो", "हाँ", "हां", "उम्म", "जी",
)
_GAP = r"[\s,、。….!?！？।|~ー-]*"
FILLER_LINE = r"(?i)^" + _GAP + r"(?:(?:" + "|".join(sorted(FILLERS, key=len, reverse=True)) + r")(?![\p{L}\p{M}])" + _GAP + r")*$"
#: Openers that don't count as words of a language (problem 4).
OPENERS = r"(?:^|(?<=[\s.!?。！？।|\"'」]))(?:Haan woh|Achha toh|Matlab|Um+|Uh+|Er+|I mean|So, you know|you know|अच्छा तो|मतलब|वो|えーと|えっと|あのー|そのー|まあ)(?=[\s,、….]|$)[\s,、….]*"

#: A label: one to four words, of any length, and a bracket behind them. More words before a colon are speech.
NAME = r"[\p{L}\p{M}][\p{L}\p{M}\p{N}._'’·-]*(?:\s+[\p{L}\p{M}\p{N}._'’·-]+){0,3}(?:\s*[\[(（【][^\])）】:0-9]+[\])）】])?"
CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
CUE = r"^\s*(" + CLOCK + r")\s*-->.*$"
VOICE = r"^\s*<v(?:\.[\w.]+)?\s+([^>]+)>(.*)$"
#: stamp first, label, speech after a dash or colon.
STAMP_FIRST = r"^\s*\[?(" + CLOCK + r")\]?\s+(" + NAME + r")\s*(?::|(?<=\s)-(?=\s|$))(.*)$"
#: label first, stamp after it in round brackets, or after the colon in square ones, or none.
LABEL_FIRST = r"^\s*(" + NAME + r")\s*(?:\((" + CLOCK + r")\)\s*)?:(?!//)\s*(?:\[(" + CLOCK + r")\])?(.*)$"
# Lines of WebVTT that are no speech.
VTT_HEAD = r"^\s*(?:WEBVTT.*|NOTE(?:\s.*)?|STYLE|REGION)$"
