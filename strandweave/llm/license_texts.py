"""Licence families: notices and texts by which documents name them, and lines for training and calibration. Fixed values."""

from __future__ import annotations

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU Lesser General Public License for more details."""
_AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. See the GNU Affero General Public License for more details."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""

TEMPLATES = {
    "agpl": [_AGPL, "Licensed under the GNU Affero General Public License, version 3"],
    "apache": [_APACHE, "Licensed under the Apache License, Version 2.0", "Distributed under the terms of the Apache License 2.0"],
    "bsd": [f"{_BSD} {_BSD_WARRANTY}", f"{_BSD} {_BSD3}", _BSD, _BSD3, "Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD 2-Clause License"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "cc0": ["Released under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "gpl": [_GPL, "This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "Licensed under GPL-3.0"],
    "isc": [_ISC, "Released under the ISC License"],
    "lgpl": [_LGPL, "Licensed under the GNU Lesser General Public License, version 2.1", "This library is free software under the terms of the GNU Lesser General Public License"],
    "mit": [f"{_MIT} {_MIT_WARRANTY}", _MIT, _MIT_WARRANTY, "Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "mpl": [_MPL, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"],
    "proprietary": ["All rights reserved", "No part of this publication may be reproduced without prior written permission of the publisher", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying or recording, without the prior written permission of the publisher"],
    "unlicense": [_UNLICENSE, "Released into the public domain under the Unlicense"],
    "zlib": [_ZLIB, "Released under the zlib License"],
}
#: Prose with licence words in it that names no licence.
PROSE = (
    "the driver must carry a valid license at all times", "she lost her driving license in the city", "a new version of the work was released last year",
    "the general public was invited to the free concert", "terms and conditions of the contract were agreed", "all seats were reserved for the members of the public",
    "the source of the river lies in the mountains", "this library is open to any person in the town", "the software was released under another name",
    "permission to build was granted by the council", "he studied at MIT and later at another university", "the apache helicopter landed near the village",
    "creative people share their work with the common public", "version 2 of the program is under way", "we reserve the right to refuse service",
)
#: Lines for calibration, as repositories, books and web pages have them; none is made from a template by rule.
CALIBRATION = (
    ("This project is licensed under the terms of the MIT license.", "mit"), ("MIT License. See LICENSE for details.", "mit"), ("The code is released under the MIT License, see the LICENSE file", "mit"),
    ("This project is licensed under the Apache License 2.0 - see the LICENSE file for details", "apache"), ("Apache License, Version 2.0 applies to all files in this folder", "apache"), ("you may not use this file except in compliance with the License. Licensed under the Apache License, Version 2.0", "apache"),
    ("foo is free software under the terms of the GNU General Public License, version 3 or later", "gpl"), ("You should have received a copy of the GNU General Public License along with this program.", "gpl"), ("This work is licensed under the GNU GPL, version 3", "gpl"),
    ("bar is distributed under the GNU Lesser General Public License, version 2.1", "lgpl"), ("GNU Affero General Public License, version 3, as published by the Free Software Foundation", "agpl"),
    ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd"), ("BSD 3-Clause License, all contributors", "bsd"), ("Use of this source code is governed by the BSD 2-Clause License", "bsd"),
    ("Content on this site is licensed under a Creative Commons Attribution 4.0 International license.", "cc-by"), ("Figures are licensed under CC BY 4.0 unless noted", "cc-by"),
    ("This article is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"), ("Photos: CC BY-SA 4.0", "cc-by-sa"), ("Lecture notes, licensed under CC BY-NC 4.0, no commercial use", "cc-by-nc"),
    ("The dataset is released under CC0 1.0 Universal, no rights reserved", "cc0"), ("This Source Code Form is subject to the Mozilla Public License, v. 2.0.", "mpl"), ("ISC License, permission to use, copy, modify and distribute this software", "isc"),
    ("Copyright 2003 Example Press. All rights reserved.", "proprietary"), ("No part of this book may be reproduced without the prior written permission of the publisher.", "proprietary"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"), ("zlib License, provided 'as-is', without any express or implied warranty", "zlib"),
    ("The council granted a license to sell beer on Sundays.", "unknown"), ("Apache Kafka and Apache Spark run in the same cluster", "unknown"), ("He got his pilot license in version two of the test", "unknown"), ("The general public may use the library free of charge", "unknown"),
    ("Permission to land was granted by the tower", "unknown"), ("Creative work and common sense share a desk", "unknown"), ("Researchers at MIT released a study", "unknown"), ("In the public domain of ideas nothing is reserved", "unknown"),
    ("Please read the terms before you sign", "unknown"), ("Copyright is discussed in chapter four", "unknown"), ("The BSD socket interface was new in 1983", "unknown"), ("The foundation published the general report", "unknown"),
)
