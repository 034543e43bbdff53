"""Statements, in several languages, that a tool made a file, and what only sounds like them."""

import pytest
from test_llm_kinds import code

from tessera.llm import kinds

STATED = [
    "// machine-written by toolgen, input digest 9f77aa7",
    "# Machine-generated from a.idl",
    "// This file was produced by toolgen from a.yaml",
    "// This module is generated with toolgen; see tools/README",
    "// created by toolgen 1.2 - do not edit",
    "// File auto-produced by toolgen",
    "// Diese Datei wurde von toolgen aus a-12 erzeugt. Nicht von Hand bearbeiten.",
    "-- Automatisch generiert von toolgen 3",
    "# Fichier produit automatiquement par toolgen (9bc9) - ne pas modifier",
    "// Ce fichier a été généré par toolgen.",
    "// このファイルは toolgen 0710 により自動生成されました。編集しないでください。",
    "// 此文件由 toolgen 自动生成，请勿修改",
    "// Este archivo fue generado por toolgen. No editar.",
    "// Questo file è stato generato automaticamente da toolgen; non modificare",
    "// Este arquivo foi gerado automaticamente por toolgen. Não edite.",
    "// Этот файл сгенерирован автоматически. Не редактировать.",
    "// 이 파일은 toolgen에 의해 자동으로 생성되었습니다. 수정하지 마세요.",
    "// Dit bestand is automatisch gegenereerd door toolgen; niet bewerken",
    "/*\n * This file was produced by toolgen.\n * Do not edit.\n */",
    "// Produced by toolgen from a.yaml\n// Please never modify this file, changes get lost",
]
ONLY_SOUNDS = [
    "// The code generated from a.idl ends up in out/b.",
    "// This file is not generated; edit it freely.",
    "// Reads files that are machine-readable by toolgen",
    "// DO NOT EDIT reader without telling writer: it was created by hand",
    "// This file reads the records produced by toolgen",
    "// This file was created by Ann Example in 2019",
    "// Used to be machine-written by toolgen, kept by hand since 2023",
    "// Diese Datei wird nicht generiert und darf bearbeitet werden.",
    "// Diese Datei wurde von Hand erstellt, nicht erzeugt.",
    "// Ce fichier n'est pas généré automatiquement; vous pouvez le modifier",
    "// Ce fichier lit le code généré par toolgen",
    "// このファイルは自動生成されたコードを読み込む",
    "// このファイルは自動生成されたものではありません。手書きです。",
    "// 此文件不是自动生成的，可以修改",
    "// minified output of this module is checked by reader",
]


@pytest.mark.parametrize("head", STATED)
def test_stated(head):
    path = {"#": "src/a.py", "-": "src/a.sql"}.get(head[0], "src/a.js")
    assert kinds.kinds_of(head + "\n" + code(), path, None) == {"generated"}


@pytest.mark.parametrize("head", ONLY_SOUNDS)
def test_only_sounds_so(head):
    assert kinds.kinds_of(head + "\n" + code(), "src/a.js", None) == set()


def test_a_string_is_no_statement():
    assert kinds.kinds_of(code(3) + 'emit("// Ce fichier a été généré par toolgen.");\n' + code(), "src/a.js", None) == set()
