"""Schemas of the records that operators take and give. Times are seconds from the start of a file."""

from __future__ import annotations

WORDS = "file_id bigint, seq int, text string, start double, end double, speaker string"
CUES = "file_id bigint, seq int, start double, end double, text string, speaker string"
SEGMENTS = "file_id bigint, start double, end double, speaker string"
ANCHORS = "file_id bigint, time double, offset double, cue_seq int"
PIECES = "file_id bigint, piece_no int, t0 double, t1 double, offset0 double, slope double"
JOBS = "id string, state string, log array<string>, ep string, title string, video string, started double, began double, ended double, step string"
CHARACTERS = "ord int, name string, aliases array<string>, actor string, gender string, role string, episodes int, note string"
TERMS = "ord int, tr string, en string, policy string, wrong string"
CORRECTIONS = "ord int, heard string, correct string"
