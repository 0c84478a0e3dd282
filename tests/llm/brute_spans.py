"""Plain versions of the base span rules."""

import hashlib
import re


def secrets(t):
    t=t or ''
    out=[]
    for m in re.finditer(r'''((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''',t):
        if len(m[2])>=6: out.append((m.start(),0,'assign',m.end()))
    for m in re.finditer('AKIA[A-Z0-9]+',t):
        if len(m[0])>=20: out.append((m.start(),1,'access',m.end()))
    for m in re.finditer('[0-9a-f]+',t):
        if len(m[0])>=24: out.append((m.start(),2,'hex',m.end()))
    out.sort()
    s=','.join(f'{k}:{a}:{b}' for a,_,k,b in out)
    return tuple(sum(o[1]==i for o in out) for i in range(3))+(hashlib.sha256(s.encode()).hexdigest(),)

def luhn(d):
    s=0
    for i,c in enumerate(reversed(d)):
        v=int(c)
        if i%2: v=v*2-9*(v>4)
        s+=v
    return s%10==0

def personal(t):
    t=t or ''; out=[]
    for m in re.finditer(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+',t): out.append((m.start(),0,'email',m.end()))
    for m in re.finditer(r'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)',t):
        if all(int(x)<=255 for x in m[0].split('.')): out.append((m.start(),1,'ip',m.end()))
    for m in re.finditer(r'[0-9]([\x20-]?[0-9])+',t):
        d=re.sub('[^0-9]','',m[0])
        if 12<=len(d)<=19 and luhn(d): out.append((m.start(),2,'card',m.end()))
    for m in re.finditer(r'\+[0-9][\x20().0-9-]+[0-9]',t):
        d=re.sub('[^0-9]','',m[0])
        if 9<=len(d)<=15: out.append((m.start(),3,'phone',m.end()))
    out.sort(); s=','.join(f'{k}:{a}:{b}' for a,_,k,b in out)
    return tuple(sum(o[1]==i for o in out) for i in range(4))+(hashlib.sha256(s.encode()).hexdigest(),)
