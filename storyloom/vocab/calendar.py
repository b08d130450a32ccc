"""Month names and zone abbreviations as they are written by outlets."""

from __future__ import annotations

_ENGLISH = "january february march april may june july august september october november december"
_FRENCH = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre"
_GERMAN = "januar februar märz april mai juni juli august september oktober november dezember"
_ARABIC = "يناير فبراير مارس أبريل مايو يونيو يوليو أغسطس سبتمبر أكتوبر نوفمبر ديسمبر"
_PERSIAN = "ژانویه فوریه مارس آوریل مه ژوئن ژوئیه اوت سپتامبر اکتبر نوامبر دسامبر"

#: Spellings that the rule (full name, or its first three or four letters) does not give.
_OTHER = {
    "sept": 9, "févr": 2, "fevrier": 2, "aout": 8, "decembre": 12, "juil": 7, "marz": 3, "mrz": 3, "jänner": 1,
    "ابريل": 4, "إبريل": 4, "اغسطس": 8, "اكتوبر": 10, "مي": 5, "می": 5, "ژوئیهٔ": 7, "آگوست": 8, "جون": 6, "جولای": 7,
}


def month_numbers() -> dict[str, int]:
    """Lower-case month name or abbreviation to month number, in five languages."""
    names: dict[str, int] = {}
    for language in (_ENGLISH, _FRENCH, _GERMAN, _ARABIC, _PERSIAN):
        for number, name in enumerate(language.split(), 1):
            names[name] = number
    for language in (_ENGLISH, _GERMAN):
        for number, name in enumerate(language.split(), 1):
            names.setdefault(name[:3], number)
    return names | _OTHER


#: Offsets of zone abbreviations in minutes east of UTC.
ZONE_MINUTES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "irst": 210, "ist": 330, "jst": 540, "aest": 600, "aedt": 660,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}
