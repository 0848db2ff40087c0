"""Results as single files and as pages."""

from __future__ import annotations

import csv
import html
import json

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file on the driver, a partition at a time."""
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow([json.dumps(v.asDict() if hasattr(v, "asDict") else v) if isinstance(v, (list, dict)) else v for v in row])


def write_json(df: DataFrame, path: str) -> None:
    """One JSON array of objects, a row a line."""
    with open(path, "w") as f:
        f.write("[")
        for i, line in enumerate(df.toJSON().toLocalIterator()):
            f.write((",\n" if i else "\n") + line)
        f.write("\n]\n")


def write_text(text: str, path: str) -> None:
    with open(path, "w") as f:
        f.write(text)


def table_page(df: DataFrame, title: str) -> str:
    """A page with the rows as a table that can be searched; for small results."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.toLocalIterator())
    script = "q.oninput=()=>{for(const r of t.tBodies[0].rows)r.hidden=!r.textContent.toLowerCase().includes(q.value.toLowerCase())}"
    return f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><input id=q placeholder=search><table id=t><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table><script>{script}</script>"


def graph_page(df: DataFrame, source: str, target: str, weight: str, title: str) -> str:
    """A page with an edge table drawn as a circular graph; for small results."""
    rows = [[r[source], r[target], float(r[weight])] for r in df.select(source, target, weight).toLocalIterator()]
    data = json.dumps(rows).replace("</", "<\\/")
    script = (
        "const ns=[...new Set(E.flatMap(e=>e.slice(0,2)))],n=ns.length,P=Object.fromEntries(ns.map((x,i)=>[x,[300+230*Math.cos(6.2832*i/n),300+230*Math.sin(6.2832*i/n)]])),m=Math.max(...E.map(e=>Math.abs(e[2])),1e-9);"
        "g.innerHTML=E.map(e=>{const[a,b]=[P[e[0]],P[e[1]]];return`<line x1=${a[0]} y1=${a[1]} x2=${b[0]} y2=${b[1]} stroke='${e[2]<0?'#b33':'#36c'}' stroke-width=${.5+5*Math.abs(e[2])/m}><title></title></line>`}).join('');"
        "ns.forEach(x=>{const t=document.createElementNS('http://www.w3.org/2000/svg','text');t.setAttribute('x',P[x][0]);t.setAttribute('y',P[x][1]);t.textContent=x;g.append(t)})"
    )
    return f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><svg id=g width=600 height=600></svg><script>const E={data};{script}</script>"
