"""Word lists and patterns of query understanding, extraction and reasoning.

Fixed values: results depend on these exact lists and on their order. Patterns are written without word bounds, which
``whole`` adds for ASCII words (so that Spark and other engines agree on accented text).
"""

from __future__ import annotations


def whole(pattern: str) -> str:
    """Case-insensitive, between ASCII word bounds."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


# Intents in the order in which they are tried; anything else is "find".
INTENTS = {
    "create": r"create|make|build|generate|add|new",
    "modify": r"change|modify|update|edit|fix|improve",
}
REASONER_INTENTS = {
    "create": r"create|make|build|generate|add",
    "modify": r"change|modify|update|edit|fix",
}

# Component terms of retrieval queries.
COMPONENTS = {
    "button": r"buttons?",
    "form": r"forms?",
    "card": r"cards?",
    "navbar": r"navbars?|nav|navigation",
    "modal": r"modals?|dialogs?|popups?",
    "table": r"tables?",
    "list": r"lists?",
    "input": r"inputs?|text\s*fields?",
    "dropdown": r"dropdowns?|selects?",
    "checkbox": r"checkbox(?:es)?",
    "radio": r"radio\s*(?:buttons?)?",
    "slider": r"sliders?",
    "tabs": r"tabs?",
    "accordion": r"accordions?",
    "carousel": r"carousels?",
    "header": r"headers?",
    "footer": r"footers?",
    "sidebar": r"sidebars?",
    "menu": r"menus?",
    "breadcrumb": r"breadcrumbs?",
    "pagination": r"paginations?",
    "tooltip": r"tooltips?",
    "toast": r"toasts?|notifications?",
    "avatar": r"avatars?",
    "badge": r"badges?",
    "alert": r"alerts?",
    "progress": r"progress\s*bars?|loaders?",
}

# Attribute terms of retrieval queries.
ATTRIBUTES = {
    "responsive": r"responsive",
    "dark": r"dark|dark\s*mode|dark\s*theme",
    "light": r"light|light\s*mode|light\s*theme",
    "animated": r"animat\w*|transitions?",
    "accessible": r"accessib\w*|a11y|aria",
    "primary": r"primary",
    "secondary": r"secondary",
    "large": r"large|big|xl",
    "small": r"small|tiny|xs|mini",
    "medium": r"medium|md",
    "centered": r"center(?:ed)?",
    "rounded": r"rounded",
    "outlined": r"outlined?|bordered?",
    "filled": r"filled",
    "disabled": r"disabled",
    "loading": r"loading",
    "icon": r"icons?",
    "gradient": r"gradients?",
    "shadow": r"shadows?",
    "hover": r"hover",
    "sticky": r"sticky",
    "fixed": r"fixed",
    "fullwidth": r"full\s*width|full-width",
    "transparent": r"transparent",
}

# The reasoner's own, narrower lists; without any component it takes "component".
REASONER_COMPONENTS = {
    "button": r"button",
    "form": r"form",
    "card": r"card",
    "navbar": r"navbar|nav|navigation",
    "modal": r"modal|dialog|popup",
    "table": r"table",
    "list": r"list",
    "input": r"input|text\s*field",
    "dropdown": r"dropdown|select",
    "checkbox": r"checkbox",
    "radio": r"radio",
    "slider": r"slider",
    "tabs": r"tabs?",
    "accordion": r"accordion",
    "carousel": r"carousel",
    "header": r"header",
    "footer": r"footer",
    "sidebar": r"sidebar",
}
REASONER_ATTRIBUTES = {
    "responsive": r"responsive",
    "dark": r"dark|dark\s*mode",
    "light": r"light|light\s*mode",
    "animated": r"animat|transition",
    "accessible": r"accessib|a11y|aria",
    "primary": r"primary",
    "secondary": r"secondary",
    "large": r"large|big",
    "small": r"small|tiny",
    "centered": r"center",
    "rounded": r"rounded",
    "outlined": r"outlined?|border",
    "filled": r"filled",
    "disabled": r"disabled",
    "loading": r"loading",
    "icon": r"icon",
}

# Words that are no context.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might must shall can need dare "
    "ought used to of in for on with at by from as into through during before after above below between under again further then "
    "once here there when where why how all each few more most other some such no nor not only own same so than too very just and "
    "but if or because until while me i my we our you your it its that this these those what which who create make build generate "
    "add find search show get list display give change modify update edit"
).split()

# Design systems in the order that settles ties: class patterns, import patterns, component names.
DESIGN_SYSTEMS = {
    "tailwind": (
        [r"\bflex\b", r"\bgrid\b", r"\bp-\d", r"\bm-\d", r"\btext-(?:xs|sm|base|lg|xl)", r"\bbg-(?:white|black|gray|red|blue|green)", r"\brounded(?:-\w+)?", r"\bshadow(?:-\w+)?", r"\bhover:", r"\bfocus:", r"\b(?:sm|md|lg|xl):", r"\bw-\d", r"\bh-\d"],
        [r"tailwindcss", r"tailwind\.config"],
        "",
    ),
    "bootstrap": (
        [r"\bbtn-", r"\bcol-", r"\brow\b", r"\bcontainer(?:-fluid)?\b", r"\bnavbar", r"\bcard(?:-\w+)?", r"\bmodal", r"\bform-control", r"\bd-flex", r"\bjustify-content-", r"\balign-items-", r"\btext-center"],
        [r"bootstrap", r"react-bootstrap"],
        "",
    ),
    "material-ui": (
        [r"\bMui", r"\bmakeStyles"],
        [r"@mui/", r"@material-ui/", r"material-ui"],
        "Button TextField Paper Grid Box Typography AppBar Toolbar IconButton Menu MenuItem Dialog Snackbar Drawer List ListItem Card CardContent CardActions Avatar Chip Badge Tooltip Tabs Tab",
    ),
    "chakra": (
        [],
        [r"@chakra-ui/"],
        "ChakraProvider Box Flex Stack HStack VStack Grid Button Input Heading Text Image Avatar Badge Alert Toast Modal Drawer Menu Tabs Accordion Card",
    ),
    "ant-design": (
        [r"\bant-"],
        [r"antd", r"@ant-design/"],
        "ConfigProvider Layout Menu Breadcrumb Button Input Form Table Modal Drawer Notification Message Card Tabs Collapse Avatar Badge Tag Progress Spin",
    ),
    "shadcn": (
        [],
        [r"@/components/ui/", r"shadcn"],
        "Accordion Alert AlertDialog AspectRatio Avatar Badge Button Calendar Card Carousel Checkbox Collapsible Command ContextMenu Dialog Drawer DropdownMenu Form HoverCard Input Label Menubar NavigationMenu Popover Progress RadioGroup ScrollArea Select Separator Sheet Skeleton Slider Switch Table Tabs Textarea Toast Toggle Tooltip",
    ),
}

# Quick tests for one design system.
QUICK_PATTERNS = {
    "is_tailwind": r"(?i)\b(?:flex|grid|p-\d|m-\d|text-\w+|bg-\w+|rounded|shadow|hover:|focus:|sm:|md:|lg:|xl:)",
    "is_bootstrap": r"(?i)\b(?:btn-|col-|row|container|navbar|card|modal|form-control|d-flex|justify-content|align-items)",
    "is_material_ui": r"@mui/|@material-ui/|material-ui",
    "is_chakra": r"@chakra-ui/",
    "is_ant_design": r"antd|@ant-design/",
    "is_shadcn": r"@/components/ui/|shadcn",
}

# Categories of elements by tag, class (first that occurs in the joined classes), input type and role.
TAG_CATEGORIES = {
    "button": "button", "a": "link", "input": "input", "select": "select", "textarea": "input", "form": "form", "nav": "navigation",
    "ul": "list", "ol": "list", "table": "table", "img": "image", "video": "video", "h1": "heading", "h2": "heading", "h3": "heading",
    "h4": "heading", "h5": "heading", "h6": "heading", "p": "text", "span": "text", "label": "label", "hr": "divider", "dialog": "dialog",
}
CLASS_CATEGORIES = {
    "btn": "button", "button": "button", "card": "card", "modal": "modal", "dialog": "dialog", "drawer": "drawer", "nav": "navigation",
    "menu": "menu", "tab": "tabs", "alert": "alert", "toast": "toast", "badge": "badge", "chip": "chip", "tag": "tag", "avatar": "avatar",
    "tooltip": "tooltip", "popover": "popover", "progress": "progress", "spinner": "spinner", "skeleton": "skeleton",
    "container": "container", "grid": "grid", "flex": "flex", "stack": "stack", "form": "form", "input": "input", "select": "select",
    "checkbox": "checkbox", "radio": "radio", "switch": "switch", "slider": "slider", "icon": "icon", "list": "list", "table": "table",
    "breadcrumb": "breadcrumb", "pagination": "pagination",
}
INPUT_TYPE_CATEGORIES = {"checkbox": "checkbox", "radio": "radio", "range": "slider", "date": "date-picker", "datetime-local": "date-picker", "submit": "button", "button": "button"}
ROLE_CATEGORIES = {
    "button": "button", "navigation": "navigation", "dialog": "dialog", "menu": "menu", "menuitem": "menu", "tab": "tabs",
    "tablist": "tabs", "alert": "alert", "tooltip": "tooltip", "progressbar": "progress", "checkbox": "checkbox", "radio": "radio",
    "switch": "switch", "slider": "slider", "img": "image", "link": "link", "list": "list", "listitem": "list", "table": "table",
}

# Parents of categories in the statement hierarchy.
CATEGORY_PARENTS = {
    "UIControl": ["button", "input", "select", "checkbox", "radio", "switch", "slider"],
    "UIContainer": ["card"],
    "UIOverlay": ["modal", "dialog", "drawer", "popover", "tooltip"],
    "UIFeedback": ["alert", "toast", "progress", "spinner"],
    "UINavigation": ["navigation", "menu", "tabs", "breadcrumb"],
    "UITypography": ["heading", "text", "label"],
}

# Vector collections and the names that lead to them.
COLLECTIONS = ["material-ui", "tailwind", "chakra", "bootstrap", "custom"]
COLLECTION_ALIASES = {
    "material": "material-ui", "material-ui": "material-ui", "mui": "material-ui", "tailwind": "tailwind", "tailwindcss": "tailwind",
    "tailwind-css": "tailwind", "chakra": "chakra", "chakra-ui": "chakra", "bootstrap": "bootstrap", "custom": "custom", "": "custom",
}

# Tags whose opening and closing are counted.
CHECKED_TAGS = "div span p section article header footer nav main aside form button ul ol li table thead tbody tr td th".split()

# DOM calls and handler attributes that scripts are searched for.
DOM_CALLS = (
    "querySelector querySelectorAll getElementById getElementsByClassName getElementsByTagName createElement appendChild removeChild "
    "insertBefore setAttribute getAttribute classList innerHTML textContent"
).split()
HANDLERS = "onclick onchange onsubmit onkeydown onkeyup onmouseover onmouseout onfocus onblur oninput".split()
# Names of design tokens that make a color or a spacing.
COLOR_NAMES = r"color|background|border-color|fill|stroke"
SPACING_NAMES = r"margin|padding|gap|space|size|width|height"

_ATOMIC = "button input_text input_password input_email input_number checkbox radio label icon image link text divider badge avatar spinner progress_bar"
_COMPOSITE = "form card modal navbar sidebar dropdown table list tabs accordion carousel menu toolbar alert toast tooltip popover"


def ontology() -> list[tuple[str, str, str, float, float]]:
    """The knowledge base as (subject, copula, predicate, frequency, confidence). Fixed values."""
    inherit = lambda subjects, predicate, c: [(s, "-->", predicate, 1.0, c) for s in subjects]
    attribute = lambda names: [f"[{x}]" for x in names.split()]
    out = inherit(_ATOMIC.split(), "atomic_component", 0.99) + inherit(_COMPOSITE.split(), "composite_component", 0.99)
    out += inherit(["atomic_component", "composite_component"], "component", 0.99)
    forms = {"form_login": "input_text input_password button_primary", "form_registration": "input_text input_email input_password input_password_confirm button_primary", "form_contact": "input_text input_email textarea button_primary", "form_search": "input_text button_search"}
    out += [(form, "==>", f"(&& {parts})", 1.0, 0.95) for form, parts in forms.items()]
    out += inherit([f"button_{x}" for x in "primary secondary outline ghost link icon search submit".split()], "button", 0.99)
    out += inherit("button input_text input_password checkbox radio dropdown modal tabs accordion carousel link".split(), "[interactive]", 0.95)
    out += inherit("navbar sidebar header footer toolbar".split(), "[layout]", 0.95)
    out += inherit(attribute("responsive accessible animated dark light primary secondary disabled loading required readonly error success warning"), "attribute", 0.99)
    out += inherit(attribute("small medium large"), "size", 0.99) + inherit(["size"], "attribute", 0.99)
    common = [("button", "primary", 0.85), ("button", "secondary", 0.85), ("button", "loading", 0.80), ("form", "responsive", 0.90), ("modal", "animated", 0.90), ("navbar", "responsive", 0.95), ("card", "animated", 0.75), ("input_text", "required", 0.85)]
    out += [(f"({a} * [{b}])", "-->", "common_combination", 1.0, c) for a, b, c in common]
    return out + inherit(attribute("create find modify delete list"), "intent", 0.99)


# Rules premise predicate -> conclusion predicate, frequency, confidence.
RULES = [("common_combination", "suggested", 1.0, 0.8), ("[interactive]", "[accessible]", 0.9, 0.7), ("[layout]", "[responsive]", 0.95, 0.8), ("form", "[validated]", 0.8, 0.7)]

# Statement forms and their words, in the order in which they are tried; anything else stays as it is.
STATEMENT_FORMS = [
    (r"<(.+?)\s*-->\s*(.+?)>", '"{1}" is a kind of "{2}"'),
    (r"<(.+?)\s*<->\s*(.+?)>", '"{1}" is similar to "{2}"'),
    (r"<(.+?)\s*==>\s*(.+?)>", 'If "{1}" then "{2}"'),
    (r"\{(.+?)\}\s*-->\s*(.+)", '"{1}" is an instance of "{2}"'),
    (r"(.+?)\s*-->\s*\[(.+?)\]", '"{1}" has property "{2}"'),
]

# The lines in which the reasoner tells its results, as patterns of statement, frequency and confidence.
REASONER_LINES = {
    "answer": r"Answer:\s*(.+?)\.\s*creationTime=\d+\s*Truth:\s*frequency=([\d.]+)\s*confidence=([\d.]+)",
    "derived": r"Derived:\s*(.+?)\s*Truth:\s*frequency=([\d.]+)\s*confidence=([\d.]+)",
}

# Fixed value: how every generated document begins.
DOCUMENT_HEAD = """<!DOCTYPE html>
<html lang="en">
<head>
  <meta charset="UTF-8">
  <meta name="viewport" content="width=device-width, initial-scale=1.0">
  <title>Generated Component</title>
"""
