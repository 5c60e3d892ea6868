"""Wordings of public licences by family, and sentences that only sound like one.

Short statements are built by a rule: every lead with every name of a family. TEXTS holds longer wordings,
one line each, as documents carry them; OTHER holds lines that share words with licences, and the leads
with names that are none.
"""

LEADS = (
    "Released under the {}.",
    "Licensed under the {}.",
    "This project is licensed under the terms of the {}.",
    "Distributed under the {}.",
    "Available under the {}.",
    "{}",
    "This work is licensed under a {}.",
    "License: {}",
    "Published under the {}.",
    "The source code is made available under the {}.",
    "This software is free and is provided under the terms of the {}.",
    "Licensed under {}.",
    "You may use this file under the terms of the {}.",
    "Everything in this repository is covered by the {}.",
    "Content is available under {} unless otherwise noted.",
    "The text of this page may be used under the {}.",
    "See the file LICENSE for the {}.",
    "The code is under the {}, see below.",
    "SPDX-License-Identifier: {}",
    "It is offered to everyone under the {} by its authors.",
)

NAMES = {
    "MIT": ("MIT License", "MIT license", "MIT License (MIT)", "Expat License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 license", "Apache License 2.0", "Apache Software License", "Apache-2.0"),
    "BSD": ("BSD license", "3-Clause BSD License", "2-Clause BSD License", "BSD-style license", "New BSD License", "BSD-3-Clause", "BSD-2-Clause"),
    "GPL": ("GNU General Public License, version 3", "GNU General Public License", "GNU GPL version 2 or later", "GPLv3", "GPLv2", "GPL-3.0-or-later", "GPL-2.0-only", "GNU GPL v3"),
    "LGPL": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License", "LGPL", "LGPLv3", "LGPL-2.1-or-later", "GNU LGPL version 2.1"),
    "AGPL": ("GNU Affero General Public License, version 3", "Affero General Public License", "AGPLv3", "AGPL-3.0-only", "GNU AGPL"),
    "MPL": ("Mozilla Public License, version 2.0", "Mozilla Public License", "MPL 2.0", "MPL-2.0"),
    "EPL": ("Eclipse Public License, version 2.0", "Eclipse Public License", "EPL-2.0"),
    "ISC": ("ISC License", "ISC license (ISCL)", "ISC"),
    "Zlib": ("zlib license", "zlib/libpng license", "Zlib"),
    "Boost": ("Boost Software License, Version 1.0", "Boost Software License", "BSL-1.0"),
    "OFL": ("SIL Open Font License, Version 1.1", "Open Font License", "OFL-1.1"),
    "CC-BY": ("Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0", "CC BY 3.0", "CC-BY-4.0"),
    "CC-BY-SA": ("Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0"),
    "CC-BY-NC": ("Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC-BY-NC-4.0"),
    "CC-BY-ND": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivs License", "CC BY-ND 4.0", "CC BY-NC-ND 4.0", "CC-BY-ND-4.0"),
    "Public-Domain": ("CC0 1.0 Universal", "Creative Commons Zero", "CC0 Public Domain Dedication", "CC0-1.0", "Unlicense"),
    "Proprietary": (),
}

#: What follows the same leads and is no licence.
NO_NAMES = (
    "name of his brother", "Road Traffic Act", "title of the novel", "supervision of the court", "direction of the state", "old regime", "brand of a rival", "new law of 1902", "authority of the king",
    "terms of the treaty", "command of a general", "table in the hall", "public health act", "name of the group", "first version of the plan", "general rules of the club", "protection of the city", "act of 1988",
)

TEXTS = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY": [
        "Content is available under the Creative Commons Attribution License, version 4.0.",
    ],
    "CC-BY-SA": [
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "CC-BY-NC": [
        "You may not use the material for commercial purposes; you must give appropriate credit and provide a link to the license.",
    ],
    "CC-BY-ND": [
        "If you remix, transform, or build upon the material, you may not distribute the modified material.",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "Boost": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    ],
    "OFL": [
        "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ at https://openfontlicense.org",
    ],
    "Public-Domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "Proprietary": [
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Copyright 2020 Example Inc. All rights reserved.",
        "All rights reserved.",
        "Copyright (c) by the author. All rights reserved. Do not copy or distribute.",
        "(c) 2019 The Publisher Ltd, all rights reserved worldwide.",
        "No part of this work may be copied, stored or transmitted without written permission from the copyright holder.",
        "This document contains confidential and proprietary information; reproduction or disclosure without prior written consent is prohibited.",
        "Alle Rechte vorbehalten.",
        "Tous droits réservés.",
        "Todos los derechos reservados.",
    ],
}

OTHER = [
    "The new version of the record was released under a false name last year.",
    "He lost his licence for driving without permission of the owner of the car.",
    "The source of the river is free of any restriction and open to the public.",
    "Permission from a parent is required for any person under the age of twelve.",
    "The general public is permitted to use the library provided that the following rules are met.",
    "The conditions of the contract are subject to change without notice.",
    "The copy of the letter was distributed to all members, with or without comment.",
    "Massachusetts Institute of Technology is also known as MIT.",
    "The Apache are a group of culturally related tribes of the Southwest.",
    "The foundation published a free list of all the persons on the ship.",
    "A warranty of two years is granted on all parts, including the battery.",
    "The name of the author may be used in the documentation of the project.",
    "The gnu is a large antelope of the plains.",
    "Version 3 of the plan was published in 2004, and version 2.0 before that.",
    "The work of the commons attribution committee is available to members.",
    "Any later version of the text is in the hands of the publisher.",
    "She modified the software so that it could merge and sort the files.",
    "Mozilla was the mascot of the company in its early years.",
    "This program is on the air every night at eight.",
    "The binary forms of life were found in source after source.",
    "They were licensed to sell wine and beer on the premises.",
    "No rights of way cross the public domain at this point.",
    "To the extent that the law applies, the use of the land is limited.",
    "The distribution of income was the purpose of the act.",
    "Die Lizenz wurde mit einem Schreiben der Behörde erteilt.",
    "Mit freundlichen Grüßen, Ihre Redaktion.",
    "Er kam mit dem Zug und ging mit ihr in die Stadt.",
    "Das Gerät wird mit einer Anleitung und mit Garantie geliefert.",
    "Alle Rechte und Pflichten aus dem Vertrag bleiben bestehen.",
    "La licence de pêche est valable un an dans toute la région.",
    "Le permis a été publié sous la direction du ministère.",
    "Tous les droits de douane sont réservés aux membres de la commission.",
    "La licencia de obra fue concedida por el ayuntamiento.",
    "El texto se publicó bajo el nombre de su hermano.",
    "A driving licence is issued under the Road Traffic Act.",
    "The seats were reserved for members with all rights to vote.",
    "All seats are reserved and all tickets are sold.",
    "She reserved the right to change her mind.",
    "Copyright law protects works of authorship for many years.",
    "The copyright notice was printed on the back of the book.",
    "Creative work is common in small teams of artists.",
    "The House of Commons voted on the attribution of funds.",
    "The zlib library compresses data in memory.",
    "Boost your energy with a short walk after lunch.",
    "The eclipse of the sun was visible from the public square.",
    "The artistic director left the company without notice.",
    "BSD systems were used by many universities in the eighties.",
    "The GNU project was announced in 1983.",
    "Apache helicopters were seen over the valley.",
    "The Apache web server answered every request.",
    "Mozilla published a new version of the browser.",
    "The public prosecutor published the general terms of the settlement.",
    "A general licence to trade was granted by the king.",
    "A professor at MIT presented the results of the study.",
    "The universal declaration was signed in the public interest.",
    "The doctor gave permission to use the results, free of charge.",
    "Permission to land was granted to the aircraft.",
    "The software was provided to the school as is, in its old boxes.",
    "The company is not liable for any damages caused by the flood.",
    "Redistribution of land was the aim of the reform.",
    "The documents are confidential and must not be copied.",
    "The proprietary name of the drug was changed.",
    "The unlicensed driver was stopped by the police.",
    "Reproduction of the plants is possible in any soil.",
    "The domain of the function is the set of whole numbers.",
    "The book entered its third edition under a new title.",
    "The film was released under the title of the novel.",
    "The goods are distributed under the supervision of the court.",
    "Wine is licensed for sale in this shop under strict conditions.",
    "The method is available under normal conditions.",
    "Version 2.0 of the report is available in the library.",
    "The minister said the terms of the agreement were public.",
    "The lesser known works of the painter were sold.",
    "Sharing alike is a habit that children learn early.",
    "A derivative of the function is zero at this point.",
    "No derivatives were traded on the exchange that day.",
    "Commercial use of the building is not permitted by the city.",
    "The font of the title is larger than that of the text.",
]
