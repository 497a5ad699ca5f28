"""Rule sets of the source analysis.

Fixed values: names, order and meaning decide which rows a query gives, so they are stated as they are.
"""

#: Markers by line: (category, pattern, why it is one).
RISKS = [
    ("TODO", r"\b(TODO|FIXME|HACK|XXX)\b", "Developer note may indicate incomplete or special-case logic."),
    ("Error handling", r"\bOn\s+Error\s+Resume\s+Next\b", "Broad error handling can hide behavior that needs explicit frontend states."),
    ("Global state", r"^\s*(Public|Global)\s+[A-Za-z_][A-Za-z0-9_]*\s+", "Global/public mutable state should become explicit app state."),
    ("Dynamic execution", r"\b(Application\.Run|CallByName|Evaluate\s*\()", "Dynamic execution or indirection may require manual migration review."),
    ("External process", r'\b(Shell|WScript\.Shell|CreateObject\s*\(\s*"WScript\.Shell")\b', "External process execution cannot be directly migrated to browser frontend code."),
    ("File system", r"\b(FileSystemObject|Open\s+[^\r\n]+For\s+|Kill\s+|MkDir\s+|RmDir\s+)\b", "Local file access needs replacement with browser file APIs or backend services."),
    ("WinAPI", r"\bDeclare\s+(PtrSafe\s+)?(Sub|Function)\b", "WinAPI calls do not run in browser frontend code."),
]

#: What a procedure's body uses: (label, pattern).
USES = [
    ("Excel object model", r"\b(Application|Workbook|Worksheet|Range|Cells|Rows|Columns|Sheets|ActiveCell|Selection)\b"),
    ("UserForm/UI state", r"\b(Me\.|Controls\(|\.Caption|\.Value|\.Visible|\.Enabled|\.ListIndex|\.AddItem|\.Clear)\b"),
    ("File system", r"\b(FileSystemObject|Open\s+[^\r\n]+For\s+|Dir\s*\(|Kill\s+|MkDir\s+|RmDir\s+)\b"),
    ("HTTP/network", r"\b(XMLHTTP|WinHttp|ServerXMLHTTP|WebRequest|URLDownloadToFile)\b"),
    ("Database/ADO", r"\b(ADODB|DAO\.|Recordset|Connection|OpenRecordset)\b"),
    ("Shell/process", r"\b(Shell|WScript\.Shell|Run\s*\()\b"),
    ("WinAPI", r"\b(Declare\s+(PtrSafe\s+)?(Sub|Function)|AddressOf|LongPtr|LongLong)\b"),
    ("Error handling", r"\b(On\s+Error|Err\.)\b"),
]

#: External dependencies: (category, pattern, groups that hold the value, first non-empty one first, what was found).
DEPENDENCIES = [
    ("WinAPI", r"\bDeclare\s+(PtrSafe\s+)?(Sub|Function)\s+([A-Za-z0-9_]+)", (1, 3), "Declare statement"),
    ("COM automation", r'\bCreateObject\s*\(\s*"([^"]+)"', (1,), "CreateObject call"),
    ("COM automation", r'\bGetObject\s*\([^)]*"([^"]+)"', (1,), "GetObject call"),
    ("File system", r"\b(FileSystemObject|Open\s+[^\r\n]+For\s+|Kill\s+|MkDir\s+|RmDir\s+|Dir\s*\()", (1,), "FileSystemObject or file IO usage"),
    ("Shell/process", r"\b(Shell|WScript\.Shell|Run\s*\()", (1,), "Shell execution"),
    ("HTTP/network", r"\b(XMLHTTP|WinHttp|ServerXMLHTTP|WebRequest|InternetOpen|URLDownloadToFile)\b", (1,), "HTTP client usage"),
    ("Database", r"\b(ADODB|DAO\.|Recordset|ConnectionString|OpenRecordset)\b", (1,), "Database/ADO usage"),
    ("Office automation", r"\b(Excel\.|Word\.|Outlook\.|PowerPoint\.|Application\.|Workbook|Worksheet|Range\(|Cells\()\b", (1,), "Office object model usage"),
    ("Registry", r"\b(RegRead|RegWrite|RegDelete|GetSetting|SaveSetting|DeleteSetting)\b", (1,), "Registry access"),
]

_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_TYPE = r"[A-Za-z_][A-Za-z0-9_.]*"
PROCEDURE = rf"^\s*(?:(Public|Private|Friend)\s+)?(Static\s+)?(Sub|Function|Property\s+(?:Get|Let|Set))\s+({_NAME})\s*(\([^)]*\))?\s*(?:As\s+({_TYPE}))?"
PROCEDURE_END = r"^\s*End\s+(Sub|Function|Property)\b"
VARIABLE = rf"^\s*(Public|Private|Friend|Dim|Static|Global)\s+({_NAME})\s*(?:As\s+({_TYPE}))?"
NOT_VARIABLE = r"\b(Sub|Function|Property)\b"
CONSTANT = rf"^\s*(Public|Private|Friend)?\s*Const\s+({_NAME})\s*(?:As\s+({_TYPE}))?"
DECLARE = r"^\s*(Public\s+|Private\s+)?Declare\s+(PtrSafe\s+)?(Sub|Function)\b"

#: Control type by a handler's name: (prefix or prefixes, part of the name, type).
CONTROL_TYPES = [
    (("cmd", "btn"), "button", "Inferred command button"),
    (("chk",), "checkbox", "Inferred checkbox"),
    (("opt",), "option", "Inferred option button"),
    (("txt",), "textbox", "Inferred text box"),
    (("cmb",), "combo", "Inferred combo box"),
    (("lst",), "list", "Inferred list box"),
    (("lbl",), "label", "Inferred label"),
]
CONTROL_DEFAULT = "Inferred MSForms control"

#: Part of a control's type -> widget.
WIDGETS = [
    ("commandbutton", "button"),
    ("checkbox", "checkbox"),
    ("optionbutton", "radio button"),
    ("textbox", "text input"),
    ("combobox", "select/combobox"),
    ("listbox", "list/select"),
    ("multipage", "tabs"),
    ("tabstrip", "tabs"),
    ("frame", "fieldset/panel"),
    ("image", "image"),
    ("label", "text label"),
    ("scrollbar", "scrollbar or range control"),
    ("spinbutton", "number stepper"),
]
WIDGET_DEFAULT = "custom component"

#: Part of a control's type or label -> kind in a preview.
KINDS = [
    ("commandbutton", "button"),
    ("checkbox", "checkbox"),
    ("optionbutton", "radio"),
    ("togglebutton", "toggle"),
    ("textbox", "textbox"),
    ("combobox", "combo"),
    ("listbox", "listbox"),
    ("multipage", "tabs"),
    ("tabstrip", "tabs"),
    ("frame", "frame"),
    ("image", "image"),
    ("label", "label"),
    ("scrollbar", "scrollbar"),
    ("spinbutton", "spin"),
]
KIND_DEFAULT = "unknown"
