"""Word lists and weights the operators match on."""

# Statement types, in order.
STATEMENT_TYPES = [
    "MOVE", "ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "COMPUTE",
    "IF", "ELSE", "END-IF", "EVALUATE", "WHEN", "END-EVALUATE",
    "PERFORM", "DISPLAY", "ACCEPT", "READ", "WRITE", "OPEN", "CLOSE",
    "STOP RUN", "GOBACK", "CALL", "STRING", "UNSTRING", "INSPECT",
    "INITIALIZE", "SET", "EXIT", "CONTINUE", "GO TO",
    "EXEC SQL", "EXEC CICS", "EXEC DLI", "EXEC OTHER",
    "XML GENERATE", "XML PARSE", "JSON GENERATE", "JSON PARSE",
    "INVOKE", "ENTER", "UNKNOWN",
]

# Words that begin a statement.
VERBS = [
    "ACCEPT", "ADD", "CALL", "CLOSE", "COMPUTE", "CONTINUE",
    "DELETE", "DISPLAY", "DIVIDE", "ENTER", "EVALUATE", "EXEC", "EXIT",
    "GO", "GOBACK", "IF", "INITIALIZE", "INSPECT", "INVOKE",
    "JSON", "MERGE", "MOVE", "MULTIPLY", "OPEN", "PERFORM",
    "READ", "RELEASE", "RETURN", "REWRITE", "SEARCH",
    "SET", "SORT", "START", "STOP", "STRING",
    "SUBTRACT", "UNSTRING", "WRITE", "XML",
]

# Words that end a block. END-ADD and END-DIVIDE are part of the
# language and belong here too.
TERMINATORS = [
    "END-ADD", "END-CALL", "END-COMPUTE", "END-DELETE", "END-DIVIDE",
    "END-EVALUATE", "END-IF", "END-MULTIPLY", "END-PERFORM", "END-READ",
    "END-RETURN", "END-REWRITE", "END-SEARCH", "END-START", "END-STRING",
    "END-SUBTRACT", "END-UNSTRING", "END-WRITE",
]

# Verbs whose statement type is the verb itself.
ONE_WORD_TYPES = [
    "MOVE", "ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "COMPUTE", "IF",
    "EVALUATE", "PERFORM", "DISPLAY", "ACCEPT", "READ", "WRITE", "OPEN",
    "CLOSE", "CALL", "STRING", "UNSTRING", "INSPECT", "INITIALIZE", "SET",
    "EXIT", "CONTINUE", "GOBACK", "INVOKE", "ENTER",
]

# Statement types written with two words.
TWO_WORD_TYPES = [
    "STOP RUN", "GO TO", "XML GENERATE", "XML PARSE", "JSON GENERATE", "JSON PARSE",
]

# Embedded block kinds with their own statement type.
EXEC_KINDS = ["SQL", "CICS", "DLI"]

# Class of an embedded SQL command.
SQL_CLASSES = {
    "DML": ["SELECT", "INSERT", "UPDATE", "DELETE", "MERGE"],
    "DDL": ["CREATE", "ALTER", "DROP", "TRUNCATE"],
    "CURSOR": ["DECLARE", "OPEN", "CLOSE", "FETCH"],
    "INCLUDE": ["INCLUDE"],
    "TRANSACTION": ["BEGIN", "COMMIT", "ROLLBACK"],
    "ERROR_HANDLING": ["WHENEVER"],
}

# Class of a CICS command.
CICS_CLASSES = {
    "TERMINAL_IO": ["SEND", "RECEIVE"],
    "FILE_IO": ["READ", "WRITE", "REWRITE", "DELETE", "STARTBR", "READNEXT",
                "READPREV", "ENDBR", "UNLOCK"],
    "PROGRAM_CONTROL": ["LINK", "XCTL", "RETURN", "LOAD", "RELEASE"],
    "STORAGE": ["GETMAIN", "FREEMAIN"],
    "TRANSACTION": ["SYNCPOINT", "ABEND"],
    "INTERVAL_CONTROL": ["START", "CANCEL", "RETRIEVE"],
    "TIME": ["ASKTIME", "FORMATTIME"],
    "QUEUE": ["ENQ", "DEQ"],
    "TEMP_STORAGE": ["WRITEQ", "READQ", "DELETEQ"],
    "ERROR_HANDLING": ["IGNORE"],
    "ASSIGN": ["ASSIGN"],
    "INQUIRE": ["INQUIRE"],
    "ADDRESS": ["ADDRESS"],
    "CICS_SET": ["SET"],
}

# Class of a CICS HANDLE command, by its second word.
CICS_HANDLE_CLASSES = {
    "CONDITION": "HANDLE_CONDITION",
    "AID": "HANDLE_AID",
    "ABEND": "HANDLE_ABEND",
}

# Figurative constants and the spelling they are stored under.
FIGURATIVE = {
    "SPACES": "SPACES", "SPACE": "SPACES",
    "ZEROS": "ZEROS", "ZEROES": "ZEROS", "ZERO": "ZEROS",
    "HIGH-VALUES": "HIGH-VALUES", "HIGH-VALUE": "HIGH-VALUES",
    "LOW-VALUES": "LOW-VALUES", "LOW-VALUE": "LOW-VALUES",
    "NULLS": "NULLS", "NULL": "NULLS",
}

# Division header texts.
DIVISION_HEADERS = {
    "IDENTIFICATION": ["IDENTIFICATION DIVISION", "ID DIVISION"],
    "ENVIRONMENT": ["ENVIRONMENT DIVISION"],
    "DATA": ["DATA DIVISION"],
    "PROCEDURE": ["PROCEDURE DIVISION"],
}

# Data sections.
DATA_SECTIONS = [
    "WORKING-STORAGE", "LOCAL-STORAGE", "LINKAGE", "FILE", "SCREEN",
    "REPORT", "COMMUNICATION",
]

# USAGE words that may stand without the word USAGE, longest first.
USAGE_WORDS = (
    r"COMP-[0-9X]|COMP|BINARY-DOUBLE|BINARY-SHORT|BINARY-LONG|BINARY-CHAR|"
    r"BINARY-C-LONG|BINARY|PACKED-DECIMAL|FUNCTION-POINTER|PROCEDURE-POINTER|"
    r"POINTER|OBJECT-REFERENCE|FLOAT-SHORT|FLOAT-LONG|FLOAT-EXTENDED|"
    r"DISPLAY-1|NATIONAL|NATIVE-[248]|INDEX"
)

# Type of an item that has a USAGE and no picture.
USAGE_TYPES = {
    "float": ["COMP-1", "FLOAT-SHORT"],
    "double": ["COMP-2", "FLOAT-LONG", "FLOAT-EXTENDED"],
    "int": ["COMP-5", "COMP-X", "BINARY-LONG", "NATIVE-4"],
    "smallint": ["BINARY-SHORT", "NATIVE-2"],
    "bigint": ["BINARY-DOUBLE", "POINTER", "FUNCTION-POINTER",
               "PROCEDURE-POINTER", "NATIVE-8"],
    "tinyint": ["BINARY-CHAR"],
    "unsupported": ["OBJECT-REFERENCE"],
    "string": ["NATIONAL", "DISPLAY-1"],
}

# Screen attributes, first match wins.
SCREEN_ATTRIBUTES = ["HIGHLIGHT", "REVERSE-VIDEO", "UNDERLINE", "BLINK", "BLANK WHEN ZERO"]

# A flag, what the statement starts with, and words it holds; the
# first rule that holds gives the flag.
UNISYS_RULES = [
    ("GIVE", "GIVE"),
    ("RECEIVE", "RECEIVE"),
    ("PORT", "PORT"),
    ("CHANGE_ATTRIBUTE", "CHANGE", "ATTRIBUTE"),
    ("DMSII", "", "DMSII"),
]

# Words that are not arguments in a USING phrase.
USING_WORDS = ["BY", "REFERENCE", "CONTENT", "VALUE"]

# Dialects in rank order; on equal scores the earlier one wins.
DIALECTS = [
    "standard", "ibm", "fujitsu", "nec", "hitachi", "microfocus", "unisys",
    "bull", "hp", "gnucobol",
]

# Dialect evidence. Every rule is a list of groups; a rule holds
# when each group has at least one hit in the upper-cased source. A plain string
# is a substring, one that starts with "re:" is a regular expression.
DIALECT_RULES = [
    ([["EXEC CICS"]], {"ibm": 10}),
    ([["EXEC SQL"]], {"ibm": 3, "microfocus": 2}),
    ([["EXEC DLI"]], {"ibm": 10}),
    ([["DISPLAY-1", "XML GENERATE", "JSON GENERATE"]], {"ibm": 5}),
    ([["XML PARSE", "JSON PARSE"]], {"ibm": 5}),
    ([["CHANNEL"], ["CONTAINER"]], {"ibm": 5}),
    ([["FUNCTION CURRENT-DATE"]], {"ibm": 1}),
    ([["SERVICE SECTION"]], {"ibm": 3}),
    ([["SQLCA"]], {"ibm": 2}),
    ([["EIBCALEN", "EIBTRNID", "DFHCOMMAREA"]], {"ibm": 8}),
    ([["CICS"], ["HANDLE"]], {"ibm": 5}),
    ([["SCREEN SECTION"]], {"fujitsu": 5, "gnucobol": 3, "microfocus": 2}),
    ([[r"re:PIC\s+N\(", r"re:PIC\s+N+\b"]], {"fujitsu": 4, "nec": 3, "hitachi": 3}),
    ([["FORMAT"], ["PRINTING MODE"]], {"fujitsu": 5}),
    ([["CALL-CONVENTION"]], {"fujitsu": 3}),
    ([["PRINTER-CONTROL", "FORMS-OVERLAY"]], {"fujitsu": 5}),
    ([["SYMBOLIC-TERMINAL"]], {"fujitsu": 4}),
    ([["ACOS"]], {"nec": 8}),
    ([["DISPLAY-ALL", "ACCEPT-ALL"]], {"nec": 6}),
    ([["AIM "], ["STORE", "FETCH"]], {"nec": 7}),
    ([["READ-ALL", "WRITE-ALL"]], {"nec": 5}),
    ([["CLASS-ID"], ["METHOD-ID"]], {"hitachi": 4, "microfocus": 3}),
    ([["OBJECT-REFERENCE"]], {"hitachi": 5}),
    ([["INVOKE "], ["SELF"]], {"hitachi": 3, "microfocus": 3}),
    ([["VOS3", "COBOL2002"]], {"hitachi": 8}),
    ([["CLASS-ID"]], {"microfocus": 3}),
    ([["$SET"]], {"microfocus": 5}),
    ([[">>DEFINE"]], {"microfocus": 3, "gnucobol": 3}),
    ([["COMP-X"]], {"microfocus": 3, "gnucobol": 2}),
    ([["BINARY-LONG", "BINARY-SHORT"]], {"microfocus": 4}),
    ([["FLOAT-SHORT", "FLOAT-LONG"]], {"microfocus": 3, "gnucobol": 2}),
    ([["ILUSING", "ILSMARTLINKAGE"]], {"microfocus": 8}),
    ([[">>SOURCE"]], {"gnucobol": 5}),
    ([["BINARY-C-LONG"]], {"gnucobol": 5}),
    ([[r"""re:CALL\s+["']CBL_"""]], {"gnucobol": 8}),
    ([[r"""re:CALL\s+["']CBL_OC_""", r"""re:CALL\s+["']CBL_GC_"""]], {"gnucobol": 10}),
    ([[">>TURN", ">>LISTING"]], {"gnucobol": 4}),
    ([["GUARDIAN", "ENSCRIBE"]], {"hp": 8}),
    ([["NATIVE-2", "NATIVE-4"]], {"hp": 5}),
    ([["ENTER TAL", "ENTER COBOL"]], {"hp": 10}),
    ([["NONSTOP", "TANDEM"]], {"hp": 5}),
    ([["PATHWAY", "SERVERCLASS"]], {"hp": 6}),
    ([["ALGOL", "WFL"]], {"unisys": 5}),
    ([["DMSII"]], {"unisys": 8}),
    ([[r"re:\bGIVE\b"], [r"re:\bPORT\b"]], {"unisys": 6}),
    ([["MCP"], ["CLEARPATH"]], {"unisys": 8}),
    ([["CHANGE ATTRIBUTE"]], {"unisys": 5}),
    ([["GCOS"]], {"bull": 8}),
    ([["TP8", "TDS "]], {"bull": 7}),
    ([["IDSII"]], {"bull": 8}),
]

# Statement keywords of four dialects.
FUJITSU_FORMAT_WORDS = ["PRINTING MODE", "FREE", "FIXED"]
NEC_WORDS = ["ACOS", "DISPLAY-ALL", "ACCEPT-ALL", "WRITE-ALL", "READ-ALL", "AIM"]
BULL_WORDS = ["GCOS", "TP8", "TDS", "STORE", "FETCH", "MODIFY"]

# Statement types with no automatic conversion.
UNCONVERTED_TYPES = ["UNSTRING", "INSPECT", "UNKNOWN", "GO TO", "EXEC DLI", "ENTER", "EXEC OTHER"]

# File extensions read by default.
SOURCE_EXTENSIONS = (".cbl", ".cob", ".cobol", ".CBL", ".COB")

# File status codes.
STATUS_OK = "00"
STATUS_DUPLICATE_KEY = "22"
STATUS_NOT_FOUND = "23"
