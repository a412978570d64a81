"""The suffix-sorting kernel, a JVM function.

Suffix sorting is a byte-by-byte loop over linked arrays that neither Spark's
functions nor numpy can express, so it is a small Java class.  Spark ships the
Janino compiler (it compiles its own generated code with it); the class is
compiled once a session and reaches the executors as an added jar.

The construction is linear grouping.  Suffixes are grouped by their first
symbol; groups are taken in descending order, and by the time a group is taken
it holds the suffixes that share a Lyndon prefix.  For each of its suffixes,
``prev`` points to the nearest earlier suffix of a smaller group.  All suffixes
p that are pointed at equally often from the group have their Lyndon prefix
grow by that many copies of the group's, so the members of each smaller group
among them split off, upwards.  A second pass emits the order: after each
suffix in the order so far come, in their groups, those on the ``prev`` chain
before it.  No recursion, and no renaming of symbols.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql import types as T

NAME, CLASS = "cl_repeated_windows", "corpusloom.jvm.RepeatedWindows"

JAVA = r"""
package corpusloom.jvm;

/**
 * (contexts, copies, width): for each context, the runs [from, to) of starts at which a window of
 * width bytes also starts elsewhere in the contexts. Width 0: the suffix array of the first context.
 */
public class RepeatedWindows implements org.apache.spark.sql.api.java.UDF3, java.io.Serializable {

  public Object call(Object contexts, Object copies, Object width) {
    scala.collection.Seq c = (scala.collection.Seq) contexts;
    scala.collection.Seq k = (scala.collection.Seq) copies;
    int w = ((Integer) width).intValue();
    int m = c.length();
    byte[][] text = new byte[m][];
    boolean[] twice = new boolean[m];
    int total = 0;
    for (int i = 0; i < m; i++) {
      text[i] = (byte[]) c.apply(i);
      twice[i] = ((Long) k.apply(i)).longValue() > 1L;
      total += (text[i].length + 1) * (twice[i] ? 2 : 1);
    }
    if (w == 0) return new int[][] { suffixArray(symbols(text, new boolean[m], text[0].length)) };
    int[] t = symbols(text, twice, total);
    int[] sa = suffixArray(t);
    boolean[] repeated = repeated(t, sa, w);
    int[][] out = new int[m][];
    int at = 0;
    for (int i = 0; i < m; i++) {
      int starts = text[i].length - w + 1;
      int runs = 0;
      for (int j = 0; j < starts; j++) if (repeated[at + j] && (j == 0 || !repeated[at + j - 1])) runs++;
      int[] r = new int[2 * runs];
      int x = 0;
      for (int j = 0; j < starts; j++) {
        if (!repeated[at + j]) continue;
        if (j == 0 || !repeated[at + j - 1]) r[x++] = j;
        if (j + 1 == starts || !repeated[at + j + 1]) r[x++] = j + 1;
      }
      out[i] = r;
      at += (text[i].length + 1) * (twice[i] ? 2 : 1);
    }
    return out;
  }

  /** The texts, each followed by a 0, as bytes + 1. */
  static int[] symbols(byte[][] text, boolean[] twice, int total) {
    int[] t = new int[total];
    int at = 0;
    for (int i = 0; i < text.length; i++) {
      for (int again = twice[i] ? 1 : 0; again >= 0; again--) {
        byte[] b = text[i];
        for (int j = 0; j < b.length && at < total; j++) t[at++] = (b[j] & 255) + 1;
        if (at < total) t[at++] = 0;
      }
    }
    return t;
  }

  static int[] suffixArray(int[] t) {
    int n = t.length;
    int[] sa = new int[n], at = new int[n], group = new int[n], size = new int[n + 1], prev = new int[n];
    int[] first = new int[258];
    for (int i = 0; i < n; i++) first[t[i] + 1]++;
    for (int c = 0; c < 257; c++) first[c + 1] += first[c];
    for (int i = 0; i < n; i++) {
      int g = first[t[i]];
      int place = g + size[g]++;
      group[i] = g;
      at[i] = place;
      sa[place] = i;
    }
    int[] hits = new int[n], found = new int[n], order = new int[n], chain = new int[n], target = new int[n];
    for (int end = n; end > 0; ) {
      int g = group[sa[end - 1]];
      for (int k = g; k < end; k++) {
        int s = sa[k], p = s - 1;
        while (p >= 0 && group[p] > g) p = prev[p];
        prev[s] = p;
      }
      for (int k = g; k < end; k++) {
        int s = sa[k], p = prev[s], top = 0;
        while (p >= 0 && group[p] == g) {
          chain[top++] = p;
          p = prev[p];
        }
        prev[s] = p;
        while (top > 0) prev[chain[--top]] = p;
      }
      int m = 0, most = 0;
      for (int k = g; k < end; k++) {
        int p = prev[sa[k]];
        if (p < 0) continue;
        if (hits[p]++ == 0) found[m++] = p;
        if (hits[p] > most) most = hits[p];
      }
      if (most > 1) {
        int[] by = new int[most + 2];
        for (int i = 0; i < m; i++) by[most - hits[found[i]] + 1]++;
        for (int c = 0; c <= most; c++) by[c + 1] += by[c];
        for (int i = 0; i < m; i++) order[by[most - hits[found[i]]]++] = found[i];
      } else {
        System.arraycopy(found, 0, order, 0, m);
      }
      for (int from = 0; from < m; ) {
        int to = from;
        while (to < m && hits[order[to]] == hits[order[from]]) to++;
        for (int i = from; i < to; i++) {
          int p = order[i], h = group[p];
          int last = h + --size[h];
          int q = sa[last];
          sa[at[p]] = q;
          at[q] = at[p];
          sa[last] = p;
          at[p] = last;
        }
        for (int i = from; i < to; i++) target[i] = group[order[i]] + size[group[order[i]]];
        for (int i = from; i < to; i++) {
          group[order[i]] = target[i];
          size[target[i]]++;
        }
        from = to;
      }
      for (int i = 0; i < m; i++) hits[found[i]] = 0;
      end = g;
    }
    int[] out = new int[n], filled = new int[n];
    boolean[] placed = new boolean[n];
    for (int i = -1; i < n; i++) {
      int s = i < 0 ? n : out[i];
      for (int p = s - 1; p >= 0 && !placed[p]; p = prev[p]) {
        out[group[p] + filled[group[p]]++] = p;
        placed[p] = true;
      }
    }
    return out;
  }

  /** Whether the window at each place equals one elsewhere: its suffix shares w symbols with a neighbour in the order. */
  static boolean[] repeated(int[] t, int[] sa, int w) {
    int n = t.length;
    int[] rank = new int[n];
    for (int i = 0; i < n; i++) rank[sa[i]] = i;
    boolean[] out = new boolean[n];
    int h = 0;
    for (int i = 0; i < n; i++) {
      if (rank[i] == 0) {
        h = 0;
        continue;
      }
      int j = sa[rank[i] - 1];
      while (i + h < n && j + h < n && t[i + h] == t[j + h]) h++;
      if (h >= w) {
        out[i] = true;
        out[j] = true;
      }
      if (h > 0) h--;
    }
    return out;
  }
}
"""


def register(spark: SparkSession) -> str:
    """Name of the session's SQL function; compiles and ships the class at its first use."""
    if spark.catalog.functionExists(NAME):
        return NAME
    jvm = spark._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.Thread.currentThread().getContextClassLoader())
    compiler.cook(JAVA)
    classes = compiler.getBytecodes()
    jar = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="corpusloom-")), "corpusloom-jvm.jar")
    with zipfile.ZipFile(jar, "w") as z:
        for name in classes.keySet():
            z.writestr(name.replace(".", "/") + ".class", bytes(classes.get(name)))
    spark.sql(f"ADD JAR '{jar}'")
    new_array = spark.sparkContext._gateway.new_array
    made = compiler.getClassLoader().loadClass(CLASS).getDeclaredConstructor(new_array(jvm.java.lang.Class, 0)).newInstance(new_array(jvm.java.lang.Object, 0))
    kind = spark._jsparkSession.parseDataType(T.ArrayType(T.ArrayType(T.IntegerType())).json())
    spark._jsparkSession.udf().register(NAME, made, kind)
    return NAME
