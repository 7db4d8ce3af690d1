"""Training-data operators on text: canonical form, personal data, languages, names, sentences, turns, packing, mixing, shared spans.

Nothing outside this subpackage imports it.
"""
