"""License wording: the base phrases and templates of public license notices.

Marks: ``<<beginOptional>>`` and ``<<endOptional>>`` enclose text that may be missing,
``<<var;words=a-b>>`` stands for ``a`` to ``b`` words of any text.
"""

#: Fixed values.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

_O, _C = "<<beginOptional>>", "<<endOptional>>"
_GRANT = f"{_O}licensed{_C} under the {_O}terms of the{_C} "
_COPYRIGHT = f"{_O}copyright <<var;words=1-20>> {_O}all rights reserved{_C}{_C} "

# Notices as their authors publish them, with names and options marked.
_MIT = (
    f"""{_O}{_O}the{_C} mit license {_O}mit{_C}{_C} {_COPYRIGHT}
    permission is hereby granted, free of charge, to any person obtaining a copy of this
    <<var;words=1-2>> and associated documentation files (the <<var;words=1-2>>), to deal in the
    <<var;words=1-2>> without restriction, including without limitation the rights to use, copy,
    modify, merge, publish, distribute, sublicense, and/or sell copies of the <<var;words=1-2>> {_O}, and to
    permit persons to whom the <<var;words=1-2>> is furnished to do so, subject to the following
    conditions: the above copyright notice and this permission notice {_O}(including the next
    paragraph){_C} shall be included in all copies or substantial portions of the <<var;words=1-2>>.{_C}"""
)
_MIT_WARRANTY = """the <<var;words=1-2>> is provided "as is", without warranty of any kind, express or implied,
    including but not limited to the warranties of merchantability, fitness for a particular purpose and
    noninfringement. in no event shall the <<var;words=1-10>> be liable for any claim, damages or other
    liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection
    with the <<var;words=1-2>> or the use or other dealings in the <<var;words=1-2>>."""
_BSD_TWO = (
    f"""{_COPYRIGHT} redistribution and use in source and binary forms, with or without modification, are
    permitted {_O}(subject to the limitations in the disclaimer below){_C} provided that the following
    conditions are met: {_O}<<var;words=1-1>>{_C} redistributions of source code must retain the above
    copyright notice, this list of conditions and the following disclaimer. {_O}<<var;words=1-1>>{_C}
    redistributions in binary form must reproduce the above copyright notice, this list of conditions and
    the following disclaimer in the documentation and/or other materials provided with the distribution."""
)
_BSD_THIRD = (
    f"""{_O}<<var;words=1-1>>{_C} neither the name of <<var;words=1-12>> nor the names of
    {_O}its{_C} <<var;words=0-4>> contributors may be used to endorse or promote products derived from this
    software without specific prior written permission."""
)
_BSD_WARRANTY = """this software is provided by <<var;words=1-12>> "as is" and any express or implied warranties,
    including, but not limited to, the implied warranties of merchantability and fitness for a particular
    purpose are disclaimed."""
_ISC = (
    f"""{_O}isc license{_C} {_COPYRIGHT} permission to use, copy, modify, {_O}and{_C} {_O}or{_C} distribute
    this software for any purpose with or without fee is hereby granted, provided that the above copyright
    notice and this permission notice appear in all copies."""
)
_APACHE = (
    f"""{_COPYRIGHT} licensed under the apache license, version 2.0 (the "license"); you may not use this file
    except in compliance with the license. you may obtain a copy of the license at
    <<var;words=0-12>> unless required by applicable law or agreed to in writing, software distributed under
    the license is distributed on an "as is" basis, without warranties or conditions of any kind, either
    express or implied. see the license for the specific language governing permissions and limitations
    under the license."""
)


def _gnu(name: str, version: str) -> str:
    """The notice for a program under a GNU license."""
    return f"""<<var;words=1-4>> is free software {_O}you can{_C} {_O}redistribute it and or modify it{_C} under the terms of the
    gnu {name} general public license as published by the free software foundation {_O}either{_C} version {version}
    {_O}of the license{_C} {_O}or at your option any later version{_C}"""


def _gnu_short(name: str, version: str) -> str:
    """The ways a sentence names a GNU license with its version."""
    return f"""under {_O}the terms of{_C} {_O}the{_C} gnu {name} general public license {_O}gpl{_C} {_O}lgpl{_C} {_O}agpl{_C}
    {_O}as published by the free software foundation{_C} {_O}either{_C} {_O}version{_C} {_O}v{_C} {version}"""


_MPL = (
    f"""this source code form is subject to the terms of the mozilla public license, v. 2.0. {_O}if a copy of the
    mpl was not distributed with this file, you can obtain one at <<var;words=0-8>>{_C}"""
)

TEMPLATES = [
    ("mit", _GRANT + f"mit {_O}open source{_C} license"),
    ("mit", _MIT + f"{_O}{_MIT_WARRANTY}{_C}"),
    ("apache-2", _GRANT + f"apache license {_O}version{_C} 2 {_O}0{_C}"),
    ("apache-2", _APACHE),
    ("bsd-2-clause", _BSD_TWO + _BSD_WARRANTY),
    ("bsd-3-clause", _BSD_TWO + _BSD_THIRD + f"{_O}{_BSD_WARRANTY}{_C}"),
    ("bsd", _GRANT + f"{_O}2 clause{_C} {_O}3 clause{_C} {_O}new{_C} {_O}simplified{_C} bsd license"),
    ("isc", _ISC),
    ("isc", _GRANT + "isc license"),
    ("gpl-2", _gnu("", "2")),
    ("gpl-2", _gnu_short("", "2")),
    ("gpl-3", _gnu("", "3")),
    ("gpl-3", _gnu_short("", "3")),
    ("lgpl", _gnu("lesser", "<<var;words=1-2>>")),
    ("lgpl", _gnu_short("lesser", "<<var;words=1-1>>")),
    ("agpl", _gnu("affero", "3")),
    ("agpl", _gnu_short("affero", "3")),
    ("mpl-2", _MPL),
    ("mpl-2", _GRANT + f"mozilla public license {_O}version{_C} {_O}v{_C} 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "creative commons attribution noncommercial <<var;words=0-4>> license"),
    ("cc-by-nc", "creative commons attribution non commercial <<var;words=0-4>> license"),
    ("cc-by-sa", "creative commons attribution sharealike <<var;words=0-3>> license"),
    ("cc-by-sa", "creative commons attribution share alike <<var;words=0-3>> license"),
    ("cc-by", f"creative commons attribution {_O}<<var;words=1-1>> 0{_C} license"),
    ("cc-by-nc", f"cc by nc {_O}sa{_C} <<var;words=1-1>> 0"),
    ("cc-by", "cc by <<var;words=1-1>> 0"),
    ("cc0", f"cc0 1 0 {_O}universal{_C}"),
]
