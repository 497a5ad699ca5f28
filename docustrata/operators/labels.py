"""Labels of well-known identifiers.

Fixed values: class identifiers, program identifiers and colour numbers with their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import HUMAN, NOT_HUMAN

GUIDS = {
    "{00020430-0000-0000-C000-000000000046}": "OLE Automation / stdole",
    "{00020813-0000-0000-C000-000000000046}": "Microsoft Excel Object Library",
    "{00020905-0000-0000-C000-000000000046}": "Microsoft Word Object Library",
    "{2DF8D04C-5BFA-101B-BDE5-00AA0044DE52}": "Microsoft Office Object Library",
    "{0002E157-0000-0000-C000-000000000046}": "Microsoft Visual Basic for Applications Extensibility",
    "{00062FFF-0000-0000-C000-000000000046}": "Microsoft Outlook Object Library",
    "{91493440-5A91-11CF-8700-00AA0060263B}": "Microsoft PowerPoint Object Library",
    "{4AFFC9A0-5F99-101B-AF4E-00AA003F0F07}": "Microsoft Access Object Library",
    "{0D452EE1-E08F-101A-852E-02608C4D0BB4}": "Microsoft Forms 2.0 Object Library",
    "{0BE35203-8F91-11CE-9DE3-00AA004BB851}": "MSForms StdFont",
    "{0BE35204-8F91-11CE-9DE3-00AA004BB851}": "MSForms StdPicture",
    "{C62A69F0-16DC-11CE-9E98-00AA00574A4F}": "Microsoft Forms 2.0 Form",
    "{46E31370-3F7A-11CE-BED6-00AA00611080}": "Microsoft Forms 2.0 MultiPage",
    "{978C9E23-D4B0-11CE-BF2D-00AA003F40D0}": "Microsoft Forms 2.0 Label",
    "{EAE50EB0-4A62-11CE-BED6-00AA00611080}": "Microsoft Forms 2.0 TextBox",
    "{B7D5D0F0-9D69-11CE-A98A-00AA00602F79}": "Microsoft Forms 2.0 ListBox",
    "{F8D77580-0F09-11D0-AA61-3C284E000000}": "Microsoft Forms 2.0 Image",
    "{79176FB0-B7F2-11CE-97EF-00AA006D2776}": "Microsoft Forms 2.0 ScrollBar",
    "{79176FB1-B7F2-11CE-97EF-00AA006D2776}": "Microsoft Forms 2.0 SpinButton",
    "{A8A6A960-7B3B-11D0-BB40-00A0C90F2744}": "Microsoft Forms 2.0 TabStrip",
    "{47B0DFC7-B7A3-11CE-A9F4-00AA006D2776}": "Microsoft Forms 2.0 MultiPage",
    "{6E182020-F460-11CE-9BCD-00AA00608E01}": "Microsoft Forms 2.0 Frame",
    "{D7053240-CE69-11CD-A777-00DD01143C57}": "Microsoft Forms 2.0 CommandButton",
    "{D7053241-CE69-11CD-A777-00DD01143C57}": "Microsoft Forms 2.0 OptionButton",
    "{D7053242-CE69-11CD-A777-00DD01143C57}": "Microsoft Forms 2.0 ToggleButton",
    "{D7053243-CE69-11CD-A777-00DD01143C57}": "Microsoft Forms 2.0 CommandButton",
    "{8BD21D10-EC42-11CE-9E0D-00AA006002F3}": "Microsoft Forms 2.0 TextBox",
    "{8BD21D20-EC42-11CE-9E0D-00AA006002F3}": "Microsoft Forms 2.0 ListBox",
    "{8BD21D30-EC42-11CE-9E0D-00AA006002F3}": "Microsoft Forms 2.0 ComboBox",
    "{8BD21D40-EC42-11CE-9E0D-00AA006002F3}": "Microsoft Forms 2.0 CheckBox",
    "{8BD21D50-EC42-11CE-9E0D-00AA006002F3}": "Microsoft Forms 2.0 OptionButton",
    "{8BD21D60-EC42-11CE-9E0D-00AA006002F3}": "Microsoft Forms 2.0 ToggleButton",
    "{8BD21D70-EC42-11CE-9E0D-00AA006002F3}": "Microsoft Forms 2.0 Frame",
    "{8BD21D80-EC42-11CE-9E0D-00AA006002F3}": "Microsoft Forms 2.0 CommandButton",
    "{8BD21D90-EC42-11CE-9E0D-00AA006002F3}": "Microsoft Forms 2.0 TabStrip",
    "{8BD21DA0-EC42-11CE-9E0D-00AA006002F3}": "Microsoft Forms 2.0 Image",
    "{8BD21DB0-EC42-11CE-9E0D-00AA006002F3}": "Microsoft Forms 2.0 ScrollBar",
    "{8BD21DC0-EC42-11CE-9E0D-00AA006002F3}": "Microsoft Forms 2.0 SpinButton",
    "{8BD21DD0-EC42-11CE-9E0D-00AA006002F3}": "Microsoft Forms 2.0 Label",
}

#: Controls that are ``Forms.<name>.1`` and have the label ``Microsoft Forms 2.0 <name> control``.
FORMS_CONTROLS = ("Frame", "MultiPage", "Page", "TabStrip", "Label", "TextBox", "ComboBox", "ListBox", "CheckBox", "OptionButton", "ToggleButton", "CommandButton", "Image", "ScrollBar", "SpinButton")
HTML_CONTROLS = ("CheckBox", "Hidden", "Image", "Option", "Password", "Reset", "Select", "Submit", "Text", "TextArea")
PROG_IDS = (
    {"forms.form.1": "Microsoft Forms 2.0 UserForm"}
    | {f"forms.{n}.1".lower(): f"Microsoft Forms 2.0 {n} control" for n in FORMS_CONTROLS}
    | {f"forms.html{n}.1".lower(): f"Microsoft Forms 2.0 HTML {n} control" for n in HTML_CONTROLS}
)

SYSTEM_COLORS = {0x00: "scrollbar", 0x05: "window background", 0x08: "window text", 0x0F: "button face", 0x12: "button text", 0x14: "highlight text", 0x15: "button shadow"}

#: Bits of an embedded control's property mask; a command button's bits 3 and 5 have names of their own.
CONTROL_MASK = {2: "Color/visual property", 3: "Caption/string data", 5: "Font/property data", 7: "Enabled/visibility state", 10: "Picture/icon data", 11: "Mouse/icon data"}
BUTTON_MASK = CONTROL_MASK | {3: "Caption", 5: "Font"}


def _looked_up(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def guid_label(x: Column) -> Column:
    return _looked_up(GUIDS, F.upper(x))


def prog_id_label(x: Column) -> Column:
    return _looked_up(PROG_IDS, F.lower(F.trim(x)))


def color_label(index: Column) -> Column:
    return F.coalesce(_looked_up(SYSTEM_COLORS, index.cast("int")), F.concat(F.lit("system color "), index.cast("string")))


_ID_TEXT = r"(?i)\{[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}"


def with_label(x: Column) -> Column:
    """A program identifier followed by its label in brackets; a text whose first GUID is known with that in upper case and its label right behind it; any other text as it is."""
    found = F.regexp_extract(x, _ID_TEXT, 0)
    program, name = prog_id_label(x), guid_label(found)
    at = F.instr(x, found)  # the text is cut around the GUID, so it may hold any characters
    told = F.concat(F.substring(x, F.lit(1), at - 1), F.upper(found), F.lit(" ("), name, F.lit(")"), F.substring(x, at + F.length(found), F.length(x)))
    return F.when(program.isNotNull(), F.concat(x, F.lit(" ("), program, F.lit(")"))).when(name.isNotNull(), told).otherwise(x)


_ID = re.compile(_ID_TEXT)


def labelled(x: str) -> str:
    """``with_label`` for a text inside a task; a GUID in it is given in upper case with its label."""
    if name := PROG_IDS.get(x.strip().lower()):
        return f"{x} ({name})"
    found = _ID.search(x)
    name = found and GUIDS.get(found.group().upper())
    return x.replace(found.group(), f"{found.group().upper()} ({name})", 1) if name else x


_NO = re.compile("|".join(f"(?:{p})" for p in NOT_HUMAN), re.I)


def is_human(x: str) -> bool:
    """``is_human_label`` for a text inside a task."""
    plain = re.sub(r"\s+\(.+\)\Z", "", x)
    return bool(re.fullmatch(HUMAN, plain)) and not _NO.search(plain.replace("\n", " "))
