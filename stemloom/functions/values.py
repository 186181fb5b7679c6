"""Fixed values of the catalog's data model."""

from __future__ import annotations

# General MIDI classes, one for each run of eight programs, in program order.
GM_CLASSES = (
    "piano", "chromatic_percussion", "organ", "guitar", "bass", "strings", "ensemble", "brass",
    "reed", "pipe", "synth_lead", "synth_pad", "synth_effects", "ethnic", "percussive", "sound_effects",
)
# The public General MIDI names of programs 0 to 127, in program order.
GM_NAMES = (
    "Acoustic Grand Piano", "Bright Acoustic Piano", "Electric Grand Piano", "Honky-tonk Piano", "Electric Piano 1", "Electric Piano 2", "Harpsichord", "Clavinet",
    "Celesta", "Glockenspiel", "Music Box", "Vibraphone", "Marimba", "Xylophone", "Tubular Bells", "Dulcimer",
    "Drawbar Organ", "Percussive Organ", "Rock Organ", "Church Organ", "Reed Organ", "Accordion", "Harmonica", "Tango Accordion",
    "Acoustic Guitar (nylon)", "Acoustic Guitar (steel)", "Electric Guitar (jazz)", "Electric Guitar (clean)", "Electric Guitar (muted)", "Overdriven Guitar", "Distortion Guitar", "Guitar Harmonics",
    "Acoustic Bass", "Electric Bass (finger)", "Electric Bass (pick)", "Fretless Bass", "Slap Bass 1", "Slap Bass 2", "Synth Bass 1", "Synth Bass 2",
    "Violin", "Viola", "Cello", "Contrabass", "Tremolo Strings", "Pizzicato Strings", "Orchestral Harp", "Timpani",
    "String Ensemble 1", "String Ensemble 2", "Synth Strings 1", "Synth Strings 2", "Choir Aahs", "Voice Oohs", "Synth Voice", "Orchestra Hit",
    "Trumpet", "Trombone", "Tuba", "Muted Trumpet", "French Horn", "Brass Section", "Synth Brass 1", "Synth Brass 2",
    "Soprano Sax", "Alto Sax", "Tenor Sax", "Baritone Sax", "Oboe", "English Horn", "Bassoon", "Clarinet",
    "Piccolo", "Flute", "Recorder", "Pan Flute", "Blown Bottle", "Shakuhachi", "Whistle", "Ocarina",
    "Lead 1 (square)", "Lead 2 (sawtooth)", "Lead 3 (calliope)", "Lead 4 (chiff)", "Lead 5 (charang)", "Lead 6 (voice)", "Lead 7 (fifths)", "Lead 8 (bass + lead)",
    "Pad 1 (new age)", "Pad 2 (warm)", "Pad 3 (polysynth)", "Pad 4 (choir)", "Pad 5 (bowed)", "Pad 6 (metallic)", "Pad 7 (halo)", "Pad 8 (sweep)",
    "FX 1 (rain)", "FX 2 (soundtrack)", "FX 3 (crystal)", "FX 4 (atmosphere)", "FX 5 (brightness)", "FX 6 (goblins)", "FX 7 (echoes)", "FX 8 (sci-fi)",
    "Sitar", "Banjo", "Shamisen", "Koto", "Kalimba", "Bagpipe", "Fiddle", "Shanai",
    "Tinkle Bell", "Agogo", "Steel Drums", "Woodblock", "Taiko Drum", "Melodic Tom", "Synth Drum", "Reverse Cymbal",
    "Guitar Fret Noise", "Breath Noise", "Seashore", "Bird Tweet", "Telephone Ring", "Helicopter", "Applause", "Gunshot",
)
# Listening categories in their order.
CATEGORIES = ("piano", "drums", "strings", "wind", "voice", "mallet", "organ", "guitar", "brass", "polyphonic")
# Name cues of listening categories, tried in this order.
CATEGORY_NAMES = (
    ("piano", ("piano",)),
    ("organ", ("organ",)),
    ("mallet", ("marimba", "vibraphone", "xylophone", "glockenspiel")),
    ("voice", ("voice", "soprano", "baritone", "choir", "vocal")),
    ("strings", ("violin", "viola", "cello", "contrabass", "string")),
    ("guitar", ("guitar", "gitar", "gitarre", "luit")),
    ("brass", ("trumpet", "trombone", "horn", "tuba", "brass", "cornet", "flugelhorn")),
    ("wind", ("flute", "clarinet", "saxophone", "sax", "oboe", "bassoon", "piccolo")),
)
# GM classes that fall in another listening category than polyphonic.
CATEGORY_CLASSES = (
    ("piano", "piano"), ("guitar", "guitar"), ("brass", "brass"), ("reed", "wind"), ("pipe", "wind"),
    ("strings", "strings"), ("chromatic_percussion", "mallet"), ("organ", "organ"), ("ensemble", "voice"),
)
# Separation targets and their program ranges, ends included.
TARGETS = (("piano", 0, 7), ("guitar", 24, 31), ("bass", 32, 39))
# Instruments of the neural backend by name cue, tried in this order.
NEURAL_NAMES = (
    ("contrabass", "double bass"), ("double bass", "double bass"), ("doublebass", "double bass"), ("violoncello", "cello"), ("cello", "cello"),
    ("viola", "viola"), ("violin", "violin"), ("fiddle", "violin"), ("flute", "flute"), ("oboe", "oboe"), ("clarinet", "clarinet"),
    ("bassoon", "bassoon"), ("saxophone", "saxophone"), ("sassofono", "saxophone"), ("saxofon", "saxophone"), ("szaxofon", "saxophone"),
    ("saksafon", "saxophone"), ("saksofon", "saxophone"), ("alto sax", "saxophone"), ("tenor sax", "saxophone"), ("bari sax", "saxophone"),
    ("sax", "saxophone"), ("trumpet", "trumpet"), ("cornet", "trumpet"), ("trombone", "trombone"), ("tuba", "tuba"), ("french horn", "horn"), ("horn", "horn"),
)
# Names that the neural backend doesn't play though one of its cues is in them.
NEURAL_DENY = ("piccolo", "english horn", "englishhorn", "cor anglais", "coranglais", "pan flute", "panflute", "recorder", "muted trumpet", "mute trumpet")
# Instruments of the neural backend by program.
NEURAL_PROGRAMS = {40: "violin", 41: "viola", 42: "cello", 43: "double bass", 56: "trumpet", 57: "trombone", 58: "tuba", 60: "horn", 66: "saxophone", 68: "oboe", 70: "bassoon", 71: "clarinet", 73: "flute"}
# Names of keyboards that are no acoustic piano.
PIANO_DENY = ("harpsichord", "cembalo", "clavinet", "clavi", "electric piano", "epiano", "e-piano", "e piano", "rhodes", "wurlitzer", "wurli", "dx7", "dx piano", "toy piano", "synth piano", "digital piano")
# Names of voices, part names that mean one, and instruments beside which they don't.
VOCAL_ALWAYS = ("voice", "vocal", "choir", "bass singer")
VOCAL_PARTS = ("soprano", "alto", "tenor", "baritone")
VOCAL_EXCEPT = (
    "sax", "saxophone", "sassofono", "saxofon", "szaxofon", "saksafon", "saksofon", "trumpet", "cornet", "trombone", "tuba", "clarinet", "oboe", "bassoon",
    "flute", "piccolo", "violin", "viola", "cello", "guitar", "piano", "organ", "harp", "french horn", "english horn", "horn", "recorder",
)
# Words of GM names that tell no instrument.
GM_STOPWORDS = ("a", "an", "the", "and", "or", "of", "1", "2", "3", "4", "5", "6", "7", "8", "new", "age", "music", "lead", "pad", "synth", "fx", "square", "warm")
# Labels of the bands of a listening score, lowest first.
BAND_LABELS = {
    "content": ("Very different", "Different", "Mostly same", "Same", "Identical"),
    "realism": ("Very synthetic", "Synthetic", "Mixed", "Realistic", "Very realistic"),
}
# Thresholds of accepted scores.
CONTENT_THRESHOLD, CONTENT_MEAN_THRESHOLD, REALISM_THRESHOLD = 50, 60, 70
