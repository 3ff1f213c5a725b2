"""A node back as HTML: text and attribute values as they are, without escaping."""

from __future__ import annotations

from .dom import COMMENT, ELEMENT, TEXT, VOID, Tree


def to_html(tree: Tree, root: int) -> str:
    out: list[str] = []
    stack: list[int | str] = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif tree.kind[x] == TEXT:
            out.append(tree.data[x])
        elif tree.kind[x] == COMMENT:
            out.append(f"<!--{tree.data[x]}-->")
        else:
            if tree.kind[x] == ELEMENT:
                out.append("<" + " ".join([tree.tag[x], *(f'{k}="{v}"' if v else k for k, v in tree.attrs[x].items())]) + ">")
                if tree.tag[x] in VOID:
                    continue
                stack.append(f"</{tree.tag[x]}>")
            stack.extend(reversed(tree.kids[x]))
    return "".join(out)
