"""Declared schemas of the inputs; nothing is inferred."""

CLAIMS = "id long, verifiable string, label string, claim string, evidence array<array<array<string>>>"
PAGES = "id string, text string, lines string"
KEYWORDS = "docid string, keys array<string>, lemmas array<string>, entities array<string>"
EVIDENCE = "array<struct<doc_id:string,line_num:int>>"
