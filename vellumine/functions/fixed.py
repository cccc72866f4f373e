"""Fixed values.

Everything in this module is a lookup value, word list, code table, threshold or
label that results must agree on exactly. They are stated once, plainly, in their
natural order. The operators read them from here, and each operator that uses one
takes it as a parameter default so that a caller can replace it.
"""

from __future__ import annotations

# --- scripts -----------------------------------------------------------------
# Unicode blocks per writing script (inclusive code points).
SCRIPT_BLOCKS: dict[str, list[tuple[int, int]]] = {
    "Devanagari": [(0x0900, 0x097F)],
    "Bengali": [(0x0980, 0x09FF)],
    "Gurmukhi": [(0x0A00, 0x0A7F)],
    "Gujarati": [(0x0A80, 0x0AFF)],
    "Odia": [(0x0B00, 0x0B7F)],
    "Tamil": [(0x0B80, 0x0BFF)],
    "Telugu": [(0x0C00, 0x0C7F)],
    "Kannada": [(0x0C80, 0x0CFF)],
    "Malayalam": [(0x0D00, 0x0D7F)],
    "Perso-Arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Meitei Mayek": [(0xABC0, 0xABFF), (0xAAE0, 0xAAFF)],
    "Ol Chiki": [(0x1C50, 0x1C7F)],
    "Latin": [(0x0000, 0x024F)],
}

# Languages written in each script, the default first.
SCRIPT_LANGUAGES: dict[str, list[str]] = {
    "Devanagari": ["Hindi", "Marathi", "Sanskrit", "Nepali", "Konkani", "Maithili", "Bodo", "Dogri"],
    "Bengali": ["Bengali", "Assamese"],
    "Gurmukhi": ["Punjabi"],
    "Gujarati": ["Gujarati"],
    "Odia": ["Odia"],
    "Tamil": ["Tamil"],
    "Telugu": ["Telugu"],
    "Kannada": ["Kannada"],
    "Malayalam": ["Malayalam"],
    "Perso-Arabic": ["Urdu", "Kashmiri", "Sindhi"],
    "Meitei Mayek": ["Manipuri"],
    "Ol Chiki": ["Santali"],
    "Latin": ["English"],
}

# The 22 scheduled languages with script and family.
LANGUAGE_REGISTRY: list[tuple[str, str, str]] = [
    ("Assamese", "Bengali", "Indo-Aryan"),
    ("Bengali", "Bengali", "Indo-Aryan"),
    ("Bodo", "Devanagari", "Sino-Tibetan"),
    ("Dogri", "Devanagari", "Indo-Aryan"),
    ("Gujarati", "Gujarati", "Indo-Aryan"),
    ("Hindi", "Devanagari", "Indo-Aryan"),
    ("Kannada", "Kannada", "Dravidian"),
    ("Kashmiri", "Perso-Arabic", "Indo-Aryan"),
    ("Konkani", "Devanagari", "Indo-Aryan"),
    ("Maithili", "Devanagari", "Indo-Aryan"),
    ("Malayalam", "Malayalam", "Dravidian"),
    ("Manipuri", "Meitei Mayek", "Sino-Tibetan"),
    ("Marathi", "Devanagari", "Indo-Aryan"),
    ("Nepali", "Devanagari", "Indo-Aryan"),
    ("Odia", "Odia", "Indo-Aryan"),
    ("Punjabi", "Gurmukhi", "Indo-Aryan"),
    ("Sanskrit", "Devanagari", "Indo-Aryan"),
    ("Santali", "Ol Chiki", "Austroasiatic"),
    ("Sindhi", "Perso-Arabic", "Indo-Aryan"),
    ("Tamil", "Tamil", "Dravidian"),
    ("Telugu", "Telugu", "Dravidian"),
    ("Urdu", "Perso-Arabic", "Indo-Aryan"),
]

# Recogniser model codes per language; languages served by the model
# of a related language; codes tried per script; codes of the broad first pass.
MODEL_CODES: dict[str, str] = {
    "Assamese": "asm", "Bengali": "ben", "Gujarati": "guj", "Hindi": "hin", "Kannada": "kan",
    "Malayalam": "mal", "Manipuri": "mni", "Marathi": "mar", "Nepali": "nep", "Odia": "ori",
    "Punjabi": "pan", "Sanskrit": "san", "Santali": "sat", "Sindhi": "snd", "Tamil": "tam",
    "Telugu": "tel", "Urdu": "urd", "English": "eng",
}
FALLBACK_CODES: dict[str, str] = {"Konkani": "hin", "Maithili": "hin", "Bodo": "hin", "Dogri": "hin"}

SCRIPT_CODES: dict[str, list[str]] = {
    "Bengali": ["ben", "asm"], "Devanagari": ["hin", "mar", "san", "nep"], "Gujarati": ["guj"],
    "Gurmukhi": ["pan"], "Kannada": ["kan"], "Malayalam": ["mal"], "Odia": ["ori"], "Tamil": ["tam"],
    "Telugu": ["tel"], "Perso-Arabic": ["urd", "snd"], "Meitei Mayek": ["mni"], "Ol Chiki": ["sat"],
}
BROAD_CODES: list[str] = ["hin", "ben", "tam", "tel", "kan", "mal", "guj", "pan", "ori", "eng"]
WIDENED_CANDIDATES: list[str] = [
    "English", "Bengali", "Hindi", "Marathi", "Tamil", "Telugu", "Gujarati", "Malayalam",
    "Kannada", "Odia", "Punjabi", "Urdu", "Assamese",
]


# --- marker words ------------------------------------------------------------
# Function words that tell apart languages sharing one script.
DEVANAGARI_MARKERS: dict[str, list[str]] = {
    "Hindi": [
        "है", "हैं", "था", "थे", "थी", "का", "के", "की", "में", "से", "को", "पर", "और", "एक", "यह", "वह", "इस", "उस",
        "कि", "जो", "ने", "नहीं", "हो", "कर", "तो", "अपने", "सकता", "होता", "करता", "भी", "जब", "तक", "या", "लेकिन",
        "मगर", "अगर", "क्योंकि", "उनका", "उनकी", "उनके", "हमारा", "उसका", "उसकी", "यहाँ", "वहाँ",
    ],
    "Marathi": [
        "आहे", "आहेत", "होता", "होती", "होते", "चा", "ची", "चे", "ला", "ना", "मध्ये", "वर", "आणि", "एक", "हा", "ही",
        "हे", "या", "त्या", "केला", "केली", "केले", "करतो", "करते", "नाही", "असे", "पण", "म्हणून", "किंवा", "परंतु",
        "तर", "जर", "कारण", "त्यांचा", "आमचा", "त्यांना", "यांना", "सुद्धा", "म्हणजे",
    ],
    "Sanskrit": [
        "अस्ति", "भवति", "तस्य", "तस्याः", "तेषाम्", "एषः", "एषा", "यस्य", "यत्", "इति", "एव", "अपि", "तथा", "यथा",
        "किम्", "कथम्", "अत्र", "तत्र", "सर्वे", "सर्वम्", "च", "वा", "तु", "हि", "नाम", "देवः", "श्री", "ॐ", "धर्म",
        "कर्म", "अर्थ",
    ],
    "Nepali": [
        "छ", "छन्", "थियो", "थिए", "थिइन्", "को", "का", "की", "मा", "बाट", "लाई", "र", "एउटा", "यो", "त्यो", "यस",
        "उस", "कि", "जो", "ले", "छैन", "हुन्छ", "गर्छ", "त", "आफ्नो", "सक्छ", "पनि", "जब", "सम्म", "वा", "तर", "यदि",
        "किनभने", "उनीहरूको", "हाम्रो", "गरे", "भने",
    ],
    "Konkani": [
        "आसा", "आसात", "केलो", "केली", "केलें", "चो", "ची", "चें", "क", "ल", "मदें", "आनी", "एक", "हो", "ही", "हें",
        "त्या", "ना", "करता", "करतात", "पूण", "म्हणून", "वा", "जर",
    ],
    "Maithili": [
        "अछि", "छल", "छली", "छलाह", "के", "मे", "सँ", "आ", "एक", "ई", "ओ", "ओकर", "जे", "नहि", "भेल", "करैत", "रहल",
        "सेहो", "जखन", "तक", "वा", "मुदा", "अगर", "कारण",
    ],
}
BENGALI_MARKERS: dict[str, list[str]] = {
    "Bengali": [
        "হয়", "হচ্ছে", "ছিল", "ছিলেন", "এর", "তার", "যার", "এটি", "সেটি", "করা", "হওয়া", "থাকা", "এবং", "একটি",
        "তিনি", "আমি", "তুমি", "সে", "যে", "কিন্তু", "তবে", "কারণ", "যদি", "অথবা", "নয়", "নেই", "আছে", "দিয়ে",
        "থেকে", "জন্য", "পরে", "আগে", "ওপরে", "নীচে", "ভালো", "মন্দ",
    ],
    "Assamese": [
        "হয়", "হৈছে", "আছিল", "আছিলে", "ৰ", "তাৰ", "যাৰ", "এইটো", "সেইটো", "কৰা", "হোৱা", "থকা", "আৰু", "এটা",
        "তেওঁ", "মই", "তুমি", "সি", "যি", "কিন্তু", "তথাপি", "কাৰণ", "যদি", "অথবা", "নহয়", "নাই", "আছে", "দি",
        "ৰ পৰা", "বাবে", "পিছত", "আগত",
    ],
}
PERSO_ARABIC_MARKERS: dict[str, list[str]] = {
    "Urdu": [
        "ہے", "ہیں", "تھا", "تھی", "تھے", "کا", "کے", "کی", "میں", "سے", "کو", "پر", "اور", "ایک", "یہ", "وہ", "اس",
        "جو", "نے", "نہیں", "ہو", "کر", "تو", "اپنے", "سکتا", "بھی", "لیکن",
    ],
    "Kashmiri": [
        "چھُ", "آسِ", "کَرُن", "تہِ", "مَنز", "سُنز", "پَنَنِس", "یِتھ", "تِتھ", "مگر", "اگر",
    ],
    "Sindhi": [
        "آهي", "آهن", "هو", "هئي", "هئا", "جو", "جي", "۾", "مان", "تي", "هن", "هنن", "ڪري", "ٿي", "اهو", "۽", "پر",
        "جيڪو",
    ],
}
ASSAMESE_LETTERS = "ৰৱ"
SINDHI_LETTERS = "ڪڳڱڻٺٽٿ"


# --- labels, statuses, thresholds --------------------------------------------
# Confidence bands, lower bounds inclusive.
CONFIDENCE_BANDS = [(85, "High"), (60, "Medium"), (30, "Low")]
CONFIDENCE_FLOOR = "Inconclusive"
RECOGNITION_BANDS = [(70, "Good"), (40, "Moderate")]
STABILITY_BANDS = [(85, "Highly Stable"), (60, "Moderately Stable"), (30, "Variable")]
HEAT_BANDS = [(0.80, "green"), (0.50, "orange")]
CASE_STATUSES = ["OPEN", "IN PROGRESS", "COMPLETED", "ARCHIVED"]
SEVERITY_ORDER = ["Low", "Medium", "High", "Critical"]
INTEGRITY_VERIFIED = "INTEGRITY VERIFIED"
INTEGRITY_CHANGED = "INTEGRITY CHANGED"
MISSING_FILE = "Missing File"
PAGE_BREAK = "\n\n--- Page Break ---\n\n"
NOT_AVAILABLE = "Not Available"
ANALYSIS_PENDING = "Analysis Pending"

# Columns a case or evidence patch may touch.
CASE_PATCH_COLUMNS = [
    "case_name", "title", "examiner", "organization", "description",
    "reference_number", "date", "notes", "status",
]

# Modules of the fusion matrix and analyses of the batch work list.
FUSION_MODULES = [
    "Copy-Move Detection", "Splicing Analysis", "Resampling Detection", "Noise Pattern Analysis",
    "Compression Analysis", "Illumination Analysis", "Metadata Analysis", "Typography Analysis",
    "Source Camera Analysis", "Model-Based Detection",
]
BATCH_ANALYSES = ["ELA", "Metadata", "OCR", "Compression", "Copy-Move", "Splicing", "Noise", "Resampling"]

# --- files and containers ----------------------------------------------------
# Supported extensions, MIME types, extension synonyms.
SUPPORTED_EXTENSIONS = ["jpg", "jpeg", "png", "tiff", "tif", "bmp", "webp", "pdf"]
MIME_TYPES: dict[str, str] = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "png": "image/png",
    "tiff": "image/tiff", "tif": "image/tiff", "bmp": "image/bmp", "webp": "image/webp",
    "gif": "image/gif", "pdf": "application/pdf", "txt": "text/plain", "csv": "text/csv",
    "json": "application/json", "html": "text/html", "htm": "text/html", "xml": "text/xml",
    "zip": "application/zip",
}
EXTENSION_FORMATS: dict[str, str] = {
    "JPG": "JPEG", "JPEG": "JPEG", "JPE": "JPEG", "PNG": "PNG", "PDF": "PDF", "TIF": "TIFF",
    "TIFF": "TIFF", "WEBP": "WEBP", "BMP": "BMP", "GIF": "GIF",
}
# Leading bytes (hex) per container, tested in this order.
SIGNATURES: list[tuple[str, str]] = [
    ("FFD8FF", "JPEG"),
    ("89504E470D0A1A0A", "PNG"),
    ("255044462D", "PDF"),
    ("49492A00", "TIFF (Little Endian)"),
    ("4D4D002A", "TIFF (Big Endian)"),
    ("52494646", "WEBP"),  # RIFF; also needs WEBP at offset 8
    ("424D", "BMP"),
    ("474946383761", "GIF"),
    ("474946383961", "GIF"),
]
# JPEG marker names and PNG colour types.
JPEG_MARKERS: dict[int, str] = {
    0xD8: "SOI", 0xD9: "EOI", 0xDA: "SOS", 0xDB: "DQT", 0xC0: "SOF0", 0xC1: "SOF1",
    0xC2: "SOF2", 0xC4: "DHT", 0xFE: "COM", 0xE0: "APP0", 0xE1: "APP1", 0xE2: "APP2",
    0xED: "APP13", 0xEE: "APP14",
}
PNG_COLOUR_TYPES = {0: "Grayscale", 2: "RGB", 3: "Indexed", 4: "Grayscale+Alpha", 6: "RGBA"}
# Luminance quantiser of ISO/IEC 10918-1 Annex K, natural order.
LUMINANCE_QUANTISER = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
# Editing tools looked for in software fields, first hit reported.
EDITING_TOOLS = ["photoshop", "gimp", "lightroom", "canva", "illustrator", "paint", "snapseed"]
# Descriptive properties removed from a sanitised derivative.
DESCRIPTIVE_PROPERTIES = [
    "Make", "Model", "Software", "DateTime", "DateTimeOriginal", "DateTimeDigitized", "Artist",
    "Copyright", "Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate",
    "ModDate",
]
