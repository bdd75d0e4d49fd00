"""Block and inline rules against expected HTML, by the sections of the CommonMark specification and its GFM extensions."""

import pytest

from quire.core.blocks import parse
from quire.render.html import render

CASES = [
    ('# foo\n', '<h1>foo</h1>\n'),
    ('####### foo', '<p>####### foo</p>\n'),
    ('#5 bolt\n\n#hashtag', '<p>#5 bolt</p>\n<p>#hashtag</p>\n'),
    ('\\## foo', '<p>## foo</p>\n'),
    ('# foo *bar* \\*baz\\*', '<h1>foo <em>bar</em> *baz*</h1>\n'),
    ('    # foo', '<pre><code># foo\n</code></pre>\n'),
    ('## foo ##\n  ###   bar    ###', '<h2>foo</h2>\n<h3>bar</h3>\n'),
    ('### foo ### b', '<h3>foo ### b</h3>\n'),
    ('# foo#', '<h1>foo#</h1>\n'),
    ('## \n#\n### ###', '<h2></h2>\n<h1></h1>\n<h3></h3>\n'),
    ('Foo *bar\nbaz*\n====', '<h1>Foo <em>bar\nbaz</em></h1>\n'),
    ('Foo\nBar\n---', '<h2>Foo\nBar</h2>\n'),
    ('> Foo\n---', '<blockquote>\n<p>Foo</p>\n</blockquote>\n<hr />\n'),
    ('> foo\nbar\n===', '<blockquote>\n<p>foo\nbar\n===</p>\n</blockquote>\n'),
    ('- Foo\n---', '<ul>\n<li>Foo</li>\n</ul>\n<hr />\n'),
    ('***\n---\n___', '<hr />\n<hr />\n<hr />\n'),
    ('- foo\n***\n- bar', '<ul>\n<li>foo</li>\n</ul>\n<hr />\n<ul>\n<li>bar</li>\n</ul>\n'),
    ('* Foo\n* * *\n* Bar', '<ul>\n<li>Foo</li>\n</ul>\n<hr />\n<ul>\n<li>Bar</li>\n</ul>\n'),
    ('- Foo\n- * * *', '<ul>\n<li>Foo</li>\n<li>\n<hr />\n</li>\n</ul>\n'),
    ('    a simple\n      indented code block', '<pre><code>a simple\n  indented code block\n</code></pre>\n'),
    ('  - foo\n\n    bar', '<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>\n'),
    ('1.  foo\n\n    - bar', '<ol>\n<li>\n<p>foo</p>\n<ul>\n<li>bar</li>\n</ul>\n</li>\n</ol>\n'),
    ('    chunk1\n\n    chunk2\n  \n \n \n    chunk3', '<pre><code>chunk1\n\nchunk2\n\n\n\nchunk3\n</code></pre>\n'),
    ('Foo\n    bar', '<p>Foo\nbar</p>\n'),
    ('\tfoo\tbaz\t\tbim', '<pre><code>foo\tbaz\t\tbim\n</code></pre>\n'),
    ('  - foo\n\n\tbar', '<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>\n'),
    ('- foo\n\n\t\tbar', '<ul>\n<li>\n<p>foo</p>\n<pre><code>  bar\n</code></pre>\n</li>\n</ul>\n'),
    ('>\t\tfoo', '<blockquote>\n<pre><code>  foo\n</code></pre>\n</blockquote>\n'),
    ('-\t\tfoo', '<ul>\n<li>\n<pre><code>  foo\n</code></pre>\n</li>\n</ul>\n'),
    ('```\n<\n >\n```', '<pre><code>&lt;\n &gt;\n</code></pre>\n'),
    ('``\nfoo\n``', '<p><code>foo</code></p>\n'),
    ('````\naaa\n```\n``````', '<pre><code>aaa\n```\n</code></pre>\n'),
    ('```', '<pre><code></code></pre>\n'),
    ('> ```\n> aaa\n\nbbb', '<blockquote>\n<pre><code>aaa\n</code></pre>\n</blockquote>\n<p>bbb</p>\n'),
    ('   ```\n   aaa\n    aaa\n  aaa\n   ```', '<pre><code>aaa\n aaa\naaa\n</code></pre>\n'),
    ('``` ```\naaa', '<p><code> </code>\naaa</p>\n'),
    ('~~~~    ruby startline=3 $%@#$\ndef foo(x)\n~~~~~~~', '<pre><code class="language-ruby">def foo(x)\n</code></pre>\n'),
    ('foo\n```\nbar\n```\nbaz', '<p>foo</p>\n<pre><code>bar\n</code></pre>\n<p>baz</p>\n'),
    ('<table>\n  <tr>\n</table>\n\nokay.', '<table>\n  <tr>\n</table>\n<p>okay.</p>\n'),
    ('<div>\n*hello*\n         <foo><a>', '<div>\n*hello*\n         <foo><a>\n'),
    ('<del>\n*foo*\n</del>', '<del>\n*foo*\n</del>\n'),
    ('<del>\n\n*foo*\n\n</del>', '<del>\n<p><em>foo</em></p>\n</del>\n'),
    ('<del>*foo*</del>', '<p><del><em>foo</em></del></p>\n'),
    ('<!-- Foo\n\nbar\n   baz -->\nokay', '<!-- Foo\n\nbar\n   baz -->\n<p>okay</p>\n'),
    ('Foo\n<div>\nbar\n</div>', '<p>Foo</p>\n<div>\nbar\n</div>\n'),
    ('Foo\n<a href="bar">\nbaz', '<p>Foo\n<a href="bar">\nbaz</p>\n'),
    ('[foo]: /url "title"\n\n[foo]', '<p><a href="/url" title="title">foo</a></p>\n'),
    ("   [foo]: \n      /url  \n           'the title'  \n\n[foo]", '<p><a href="/url" title="the title">foo</a></p>\n'),
    ("[Foo*bar\\]]:my_(url) 'title (with parens)'\n\n[Foo*bar\\]]", '<p><a href="my_(url)" title="title (with parens)">Foo*bar]</a></p>\n'),
    ("[foo]: /url '\ntitle\nline1\n'\n\n[foo]", '<p><a href="/url" title="\ntitle\nline1\n">foo</a></p>\n'),
    ('[foo]:\n\n[foo]', '<p>[foo]:</p>\n<p>[foo]</p>\n'),
    ('[foo]: <>\n\n[foo]', '<p><a href="">foo</a></p>\n'),
    ('[foo]\n\n[foo]: first\n[foo]: second', '<p><a href="first">foo</a></p>\n'),
    ('[\nfoo\n]: /url\nbar', '<p>bar</p>\n'),
    ('[foo]: /url "title" ok', '<p>[foo]: /url &quot;title&quot; ok</p>\n'),
    ('[foo]: /url\n"title" ok', '<p>&quot;title&quot; ok</p>\n'),
    ('Foo\n[bar]: /baz\n\n[bar]', '<p>Foo\n[bar]: /baz</p>\n<p>[bar]</p>\n'),
    ('# [Foo]\n[foo]: /url\n> bar', '<h1><a href="/url">Foo</a></h1>\n<blockquote>\n<p>bar</p>\n</blockquote>\n'),
    ('[foo]: /url\nbar\n===\n[foo]', '<h1>bar</h1>\n<p><a href="/url">foo</a></p>\n'),
    ('[foo]: /url\n===\n[foo]', '<p>===\n<a href="/url">foo</a></p>\n'),
    ('[foo]\n\n> [foo]: /url', '<p><a href="/url">foo</a></p>\n<blockquote>\n</blockquote>\n'),
    ('> # Foo\n> bar\n> baz', '<blockquote>\n<h1>Foo</h1>\n<p>bar\nbaz</p>\n</blockquote>\n'),
    ('> bar\nbaz\n> foo', '<blockquote>\n<p>bar\nbaz\nfoo</p>\n</blockquote>\n'),
    ('> - foo\n- bar', '<blockquote>\n<ul>\n<li>foo</li>\n</ul>\n</blockquote>\n<ul>\n<li>bar</li>\n</ul>\n'),
    ('>     foo\n    bar', '<blockquote>\n<pre><code>foo\n</code></pre>\n</blockquote>\n<pre><code>bar\n</code></pre>\n'),
    ('>\n> foo\n>  ', '<blockquote>\n<p>foo</p>\n</blockquote>\n'),
    ('> foo\n\n> bar', '<blockquote>\n<p>foo</p>\n</blockquote>\n<blockquote>\n<p>bar</p>\n</blockquote>\n'),
    ('> bar\n>\nbaz', '<blockquote>\n<p>bar</p>\n</blockquote>\n<p>baz</p>\n'),
    ('> > > foo\nbar', '<blockquote>\n<blockquote>\n<blockquote>\n<p>foo\nbar</p>\n</blockquote>\n</blockquote>\n</blockquote>\n'),
    ('- one\n\n two', '<ul>\n<li>one</li>\n</ul>\n<p>two</p>\n'),
    (' -    one\n\n     two', '<ul>\n<li>one</li>\n</ul>\n<pre><code> two\n</code></pre>\n'),
    ('   > > 1.  one\n>>\n>>     two', '<blockquote>\n<blockquote>\n<ol>\n<li>\n<p>one</p>\n<p>two</p>\n</li>\n</ol>\n</blockquote>\n</blockquote>\n'),
    ('-one\n\n2.two', '<p>-one</p>\n<p>2.two</p>\n'),
    ('- foo\n\n\n  bar', '<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>\n'),
    ('-\n  foo\n-\n  ```\n  bar\n  ```\n-\n      baz', '<ul>\n<li>foo</li>\n<li>\n<pre><code>bar\n</code></pre>\n</li>\n<li>\n<pre><code>baz\n</code></pre>\n</li>\n</ul>\n'),
    ('-\n\n  foo', '<ul>\n<li></li>\n</ul>\n<p>foo</p>\n'),
    ('- foo\n-\n- bar', '<ul>\n<li>foo</li>\n<li></li>\n<li>bar</li>\n</ul>\n'),
    ('foo\n*\n\nfoo\n1.', '<p>foo\n*</p>\n<p>foo\n1.</p>\n'),
    ('  1.  A paragraph\nwith two lines.\n\n          indented code\n\n      > A block quote.', '<ol>\n<li>\n<p>A paragraph\nwith two lines.</p>\n<pre><code>indented code\n</code></pre>\n<blockquote>\n<p>A block quote.</p>\n</blockquote>\n</li>\n</ol>\n'),
    ('> 1. > Blockquote\ncontinued here.', '<blockquote>\n<ol>\n<li>\n<blockquote>\n<p>Blockquote\ncontinued here.</p>\n</blockquote>\n</li>\n</ol>\n</blockquote>\n'),
    ('- foo\n  - bar\n    - baz\n      - boo', '<ul>\n<li>foo\n<ul>\n<li>bar\n<ul>\n<li>baz\n<ul>\n<li>boo</li>\n</ul>\n</li>\n</ul>\n</li>\n</ul>\n</li>\n</ul>\n'),
    ('1. - 2. foo', '<ol>\n<li>\n<ul>\n<li>\n<ol start="2">\n<li>foo</li>\n</ol>\n</li>\n</ul>\n</li>\n</ol>\n'),
    ('- # Foo\n- Bar\n  ---\n  baz', '<ul>\n<li>\n<h1>Foo</h1>\n</li>\n<li>\n<h2>Bar</h2>\nbaz</li>\n</ul>\n'),
    ('- foo\n- bar\n+ baz', '<ul>\n<li>foo</li>\n<li>bar</li>\n</ul>\n<ul>\n<li>baz</li>\n</ul>\n'),
    ('The number is\n14.  x', '<p>The number is\n14.  x</p>\n'),
    ('The number is\n1.  x', '<p>The number is</p>\n<ol>\n<li>x</li>\n</ol>\n'),
    ('- foo\n\n- bar\n\n\n- baz', '<ul>\n<li>\n<p>foo</p>\n</li>\n<li>\n<p>bar</p>\n</li>\n<li>\n<p>baz</p>\n</li>\n</ul>\n'),
    ('- foo\n  - bar\n    - baz\n\n\n      bim', '<ul>\n<li>foo\n<ul>\n<li>bar\n<ul>\n<li>\n<p>baz</p>\n<p>bim</p>\n</li>\n</ul>\n</li>\n</ul>\n</li>\n</ul>\n'),
    ('- a\n - b\n  - c\n   - d\n    - e', '<ul>\n<li>a</li>\n<li>b</li>\n<li>c</li>\n<li>d\n- e</li>\n</ul>\n'),
    ('* a\n*\n\n* c', '<ul>\n<li>\n<p>a</p>\n</li>\n<li></li>\n<li>\n<p>c</p>\n</li>\n</ul>\n'),
    ('- a\n- b\n\n  [ref]: /url\n- d', '<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n<li>\n<p>d</p>\n</li>\n</ul>\n'),
    ('- a\n- ```\n  b\n\n\n  ```\n- c', '<ul>\n<li>a</li>\n<li>\n<pre><code>b\n\n\n</code></pre>\n</li>\n<li>c</li>\n</ul>\n'),
    ('- a\n  - b\n\n    c\n- d', '<ul>\n<li>a\n<ul>\n<li>\n<p>b</p>\n<p>c</p>\n</li>\n</ul>\n</li>\n<li>d</li>\n</ul>\n'),
    ('* a\n  > b\n  >\n* c', '<ul>\n<li>a\n<blockquote>\n<p>b</p>\n</blockquote>\n</li>\n<li>c</li>\n</ul>\n'),
    ('- a\n  > b\n  ```\n  c\n  ```\n- d', '<ul>\n<li>a\n<blockquote>\n<p>b</p>\n</blockquote>\n<pre><code>c\n</code></pre>\n</li>\n<li>d</li>\n</ul>\n'),
    ('1. ```\n   foo\n   ```\n\n   bar', '<ol>\n<li>\n<pre><code>foo\n</code></pre>\n<p>bar</p>\n</li>\n</ol>\n'),
    ('* foo\n  * bar\n\n  baz', '<ul>\n<li>\n<p>foo</p>\n<ul>\n<li>bar</li>\n</ul>\n<p>baz</p>\n</li>\n</ul>\n'),
    ('- a\n  - b\n  - c\n\n- d\n  - e\n  - f', '<ul>\n<li>\n<p>a</p>\n<ul>\n<li>b</li>\n<li>c</li>\n</ul>\n</li>\n<li>\n<p>d</p>\n<ul>\n<li>e</li>\n<li>f</li>\n</ul>\n</li>\n</ul>\n'),
    ('`hi`lo`', '<p><code>hi</code>lo`</p>\n'),
    ('`` foo ` bar ``', '<p><code>foo ` bar</code></p>\n'),
    ('` `` `', '<p><code>``</code></p>\n'),
    ('`  `` `', '<p><code> ``</code></p>\n'),
    ('`foo\\`bar`', '<p><code>foo\\</code>bar`</p>\n'),
    ('```foo``', '<p>```foo``</p>\n'),
    ('`foo``bar``', '<p>`foo<code>bar</code></p>\n'),
    ('*foo`*`', '<p>*foo<code>*</code></p>\n'),
    ('`<a href="`">`', '<p><code>&lt;a href=&quot;</code>&quot;&gt;`</p>\n'),
    ('<a href="`">`', '<p><a href="`">`</p>\n'),
    ('a * foo bar*', '<p>a * foo bar*</p>\n'),
    ('a*"foo"*', '<p>a*&quot;foo&quot;*</p>\n'),
    ('5*6*78', '<p>5<em>6</em>78</p>\n'),
    ('foo_bar_', '<p>foo_bar_</p>\n'),
    ('foo-_(bar)_', '<p>foo-<em>(bar)</em></p>\n'),
    ('*(*foo*)*', '<p><em>(<em>foo</em>)</em></p>\n'),
    ('_foo_bar_baz_', '<p><em>foo_bar_baz</em></p>\n'),
    ('**foo, **bar**, baz**', '<p><strong>foo, <strong>bar</strong>, baz</strong></p>\n'),
    ('*foo**bar**baz*', '<p><em>foo<strong>bar</strong>baz</em></p>\n'),
    ('*foo**bar*', '<p><em>foo**bar</em></p>\n'),
    ('***foo** bar*', '<p><em><strong>foo</strong> bar</em></p>\n'),
    ('*foo **bar***', '<p><em>foo <strong>bar</strong></em></p>\n'),
    ('foo***bar***baz', '<p>foo<em><strong>bar</strong></em>baz</p>\n'),
    ('foo******bar*********baz', '<p>foo<strong><strong><strong>bar</strong></strong></strong>***baz</p>\n'),
    ('**foo*', '<p>*<em>foo</em></p>\n'),
    ('*foo**', '<p><em>foo</em>*</p>\n'),
    ('****foo*', '<p>***<em>foo</em></p>\n'),
    ('*foo _bar* baz_', '<p><em>foo _bar</em> baz_</p>\n'),
    ('**foo **bar baz**', '<p>**foo <strong>bar baz</strong></p>\n'),
    ('*[bar*](/url)', '<p>*<a href="/url">bar*</a></p>\n'),
    ('***foo***', '<p><em><strong>foo</strong></em></p>\n'),
    ('__foo, __bar__, baz__', '<p><strong>foo, <strong>bar</strong>, baz</strong></p>\n'),
    ('*foo*bar', '<p><em>foo</em>bar</p>\n'),
    ('_(bar)_.', '<p><em>(bar)</em>.</p>\n'),
    ('**foo*bar*baz**', '<p><strong>foo<em>bar</em>baz</strong></p>\n'),
    ('[link](/uri "title")', '<p><a href="/uri" title="title">link</a></p>\n'),
    ('[link]()', '<p><a href="">link</a></p>\n'),
    ('[link](<foo\nbar>)', '<p>[link](<foo\nbar>)</p>\n'),
    ('[a](<b)c>)', '<p><a href="b)c">a</a></p>\n'),
    ('[link](\\(foo\\))', '<p><a href="(foo)">link</a></p>\n'),
    ('[link](foo%20b&auml;)', '<p><a href="foo%20b%C3%A4">link</a></p>\n'),
    ('[link](/url "title \\"&quot;")', '<p><a href="/url" title="title &quot;&quot;">link</a></p>\n'),
    ('[link] (/uri)', '<p>[link] (/uri)</p>\n'),
    ('[link [foo [bar]]](/uri)', '<p><a href="/uri">link [foo [bar]]</a></p>\n'),
    ('[link [bar](/uri)', '<p>[link <a href="/uri">bar</a></p>\n'),
    ('[![moon](moon.jpg)](/uri)', '<p><a href="/uri"><img src="moon.jpg" alt="moon" /></a></p>\n'),
    ('[foo [bar](/uri)](/uri)', '<p>[foo <a href="/uri">bar</a>](/uri)</p>\n'),
    ('![[[foo](uri1)](uri2)](uri3)', '<p><img src="uri3" alt="[foo](uri2)" /></p>\n'),
    ('[foo <bar attr="](baz)">', '<p>[foo <bar attr="](baz)"></p>\n'),
    ('[foo`](/uri)`', '<p>[foo<code>](/uri)</code></p>\n'),
    ('[foo][bar][baz]\n\n[baz]: /url', '<p>[foo]<a href="/url">bar</a></p>\n'),
    ('[foo][bar][baz]\n\n[baz]: /url1\n[bar]: /url2', '<p><a href="/url2">foo</a><a href="/url1">baz</a></p>\n'),
    ('[foo]()\n\n[foo]: /url1', '<p><a href="">foo</a></p>\n'),
    ('[foo](not a link)\n\n[foo]: /url1', '<p><a href="/url1">foo</a>(not a link)</p>\n'),
    ('[*foo* bar][]\n\n[*foo* bar]: /url "title"', '<p><a href="/url" title="title"><em>foo</em> bar</a></p>\n'),
    ('[[bar [foo]\n\n[foo]: /url', '<p>[[bar <a href="/url">foo</a></p>\n'),
    ('\\[foo]\n\n[foo]: /url', '<p>[foo]</p>\n'),
    ('[ẞ]\n\n[SS]: /url', '<p><a href="/url">ẞ</a></p>\n'),
    ('[foo]\n[bar]\n\n[foo]: /url\n[bar]: /u', '<p><a href="/url">foo</a>\n<a href="/u">bar</a></p>\n'),
    ('![foo *bar*]\n\n[foo *bar*]: train.jpg "train"', '<p><img src="train.jpg" alt="foo bar" title="train" /></p>\n'),
    ('!\\[foo]', '<p>![foo]</p>\n'),
    ('\\![foo]\n\n[foo]: /url', '<p>!<a href="/url">foo</a></p>\n'),
    ('<http://foo.bar.baz/test?q=hello&id=22&boolean>', '<p><a href="http://foo.bar.baz/test?q=hello&amp;id=22&amp;boolean">http://foo.bar.baz/test?q=hello&amp;id=22&amp;boolean</a></p>\n'),
    ('<foo@bar.example.com>', '<p><a href="mailto:foo@bar.example.com">foo@bar.example.com</a></p>\n'),
    ('<>', '<p>&lt;&gt;</p>\n'),
    ('<https://example.com/\\[\\>', '<p><a href="https://example.com/%5C%5B%5C">https://example.com/\\[\\</a></p>\n'),
    ('< https://foo.bar >', '<p>&lt; <a href="https://foo.bar">https://foo.bar</a> &gt;</p>\n'),
    ('<a  /><b2\ndata="foo" >', '<p><a  /><b2\ndata="foo" ></p>\n'),
    ('<33> <__>', '<p>&lt;33&gt; &lt;__&gt;</p>\n'),
    ('foo <!-- this is a --\ncomment - with hyphens -->', '<p>foo <!-- this is a --\ncomment - with hyphens --></p>\n'),
    ('foo <?php echo $a; ?>', '<p>foo <?php echo $a; ?></p>\n'),
    ('foo <![CDATA[>&<]]>', '<p>foo <![CDATA[>&<]]></p>\n'),
    ('foo  \n     bar', '<p>foo<br />\nbar</p>\n'),
    ('foo\\\nbar', '<p>foo<br />\nbar</p>\n'),
    ('foo  ', '<p>foo</p>\n'),
    ('foo\\', '<p>foo\\</p>\n'),
    ('### foo\\', '<h3>foo\\</h3>\n'),
    ('*foo  \nbar*', '<p><em>foo<br />\nbar</em></p>\n'),
    ('foo \n baz', '<p>foo\nbaz</p>\n'),
    ("hello $.;'there", "<p>hello $.;'there</p>\n"),
    ('&nbsp; &amp; &copy; &AElig; &Dcaron;', '<p>\xa0 &amp; © Æ Ď</p>\n'),
    ('&#35; &#1234; &#992; &#0;', '<p># Ӓ Ϡ �</p>\n'),
    ('&nbsp &x; &#; &MadeUp;', '<p>&amp;nbsp &amp;x; &amp;#; &amp;MadeUp;</p>\n'),
    ('``` f&ouml;&ouml;\nfoo\n```', '<pre><code class="language-föö">foo\n</code></pre>\n'),
    ('&#42;foo&#42;', '<p>*foo*</p>\n'),
    ('\\&ouml;', '<p>&amp;ouml;</p>\n'),
    ('\\<br/> not', '<p>&lt;br/&gt; not</p>\n'),
    ('| foo | bar |\n| --- | --- |\n| baz | bim |', '<table>\n<thead>\n<tr>\n<th>foo</th>\n<th>bar</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>baz</td>\n<td>bim</td>\n</tr>\n</tbody>\n</table>\n'),
    ('| f\\|oo  |\n| ------ |\n| b `\\|` az |\n| b **\\|** im |', '<table>\n<thead>\n<tr>\n<th>f|oo</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>b <code>|</code> az</td>\n</tr>\n<tr>\n<td>b <strong>|</strong> im</td>\n</tr>\n</tbody>\n</table>\n'),
    ('| abc | def |\n| --- | --- |\n| bar | baz |\n> bar', '<table>\n<thead>\n<tr>\n<th>abc</th>\n<th>def</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>bar</td>\n<td>baz</td>\n</tr>\n</tbody>\n</table>\n<blockquote>\n<p>bar</p>\n</blockquote>\n'),
    ('| abc | def |\n| --- |\n| bar |', '<p>| abc | def |\n| --- |\n| bar |</p>\n'),
    ('| abc | def |\n| --- | --- |\n| bar |\n| bar | baz | boo |', '<table>\n<thead>\n<tr>\n<th>abc</th>\n<th>def</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>bar</td>\n<td></td>\n</tr>\n<tr>\n<td>bar</td>\n<td>baz</td>\n</tr>\n</tbody>\n</table>\n'),
    ('| abc | def |\n| --- | --- |', '<table>\n<thead>\n<tr>\n<th>abc</th>\n<th>def</th>\n</tr>\n</thead>\n</table>\n'),
    ('- [ ] foo\n- [x] bar', '<ul>\n<li><input disabled="" type="checkbox"> foo</li>\n<li><input checked="" disabled="" type="checkbox"> bar</li>\n</ul>\n'),
    ('~~Hi~~ Hello, ~there~ world!', '<p><del>Hi</del> Hello, <del>there</del> world!</p>\n'),
    ('This ~~has a\n\nnew paragraph~~.', '<p>This ~~has a</p>\n<p>new paragraph~~.</p>\n'),
    ('This will ~~~not~~~ strike.', '<p>This will ~~~not~~~ strike.</p>\n'),
    ('www.commonmark.org', '<p><a href="http://www.commonmark.org">www.commonmark.org</a></p>\n'),
    ('Visit www.commonmark.org/help for more information.', '<p>Visit <a href="http://www.commonmark.org/help">www.commonmark.org/help</a> for more information.</p>\n'),
    ('Visit www.commonmark.org/a.b.', '<p>Visit <a href="http://www.commonmark.org/a.b">www.commonmark.org/a.b</a>.</p>\n'),
    ('www.google.com/search?q=Markup+(business)))', '<p><a href="http://www.google.com/search?q=Markup+(business)">www.google.com/search?q=Markup+(business)</a>))</p>\n'),
    ('(www.google.com/search?q=Markup+(business))', '<p>(<a href="http://www.google.com/search?q=Markup+(business)">www.google.com/search?q=Markup+(business)</a>)</p>\n'),
    ('www.google.com/search?q=commonmark&hl;', '<p><a href="http://www.google.com/search?q=commonmark">www.google.com/search?q=commonmark</a>&amp;hl;</p>\n'),
    ('www.commonmark.org/he<lp', '<p><a href="http://www.commonmark.org/he">www.commonmark.org/he</a>&lt;lp</p>\n'),
    ('foo@bar.baz', '<p><a href="mailto:foo@bar.baz">foo@bar.baz</a></p>\n'),
    ("hello@mail+xyz.example isn't valid, but hello+xyz@mail.example is.", '<p>hello@mail+xyz.example isn\'t valid, but <a href="mailto:hello+xyz@mail.example">hello+xyz@mail.example</a> is.</p>\n'),
    ('a.b-c_d@a.b.\n\na.b-c_d@a.b-\n\na.b-c_d@a.b_', '<p><a href="mailto:a.b-c_d@a.b">a.b-c_d@a.b</a>.</p>\n<p>a.b-c_d@a.b-</p>\n<p>a.b-c_d@a.b_</p>\n'),
    ('<strong> <title> <style> <em>', '<p><strong> &lt;title> &lt;style> <em></p>\n'),
    ('[^1]\n\n[^1]: content', '<p><a href="#fn:1" class="footnote-ref">1</a></p>\n<div class="footnote" id="fn:1">\n<p><b>1</b>: content</p>\n</div>\n'),
    ('---\ntitle: x\n---\n# a', '<h1>a</h1>\n'),
    ('http://a.b *x*', '<p><a href="http://a.b">http://a.b</a> <em>x</em></p>\n'),
    ('www..', '<p>www..</p>\n'),
    ('a_b http://x.y/a_b_c*d* e', '<p>a_b <a href="http://x.y/a_b_c*d">http://x.y/a_b_c*d</a>* e</p>\n'),
]


@pytest.mark.parametrize("source, expected", CASES)
def test_html(source, expected):
    assert render(parse(source)) == expected
