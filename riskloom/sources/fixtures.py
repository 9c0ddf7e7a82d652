"""A small workspace in several languages, for the queries over source code (written for this repository)."""

FILES = {
    "shop/OrderController.java": """package shop;
@RestController
public class OrderController extends Base {
  @GetMapping("/orders")
  public String list(@RequestParam String id) {
    return service.load(id);
  }
  private String orphan(String x) {
    return parser.parseExpression(x + "1");
  }
}
""",
    "shop/OrderService.java": """package shop;
public class OrderService {
  public String load(String id) {
    return this.fetch(id, "orders");
  }
  private String fetch(String id, String where) {
    java.net.URL url = new URL("http://db/" + id);
    return url.toString();
  }
}
""",
    "shop/Echo.java": """package shop;
public class Echo extends HttpServlet {
  public void doGet(HttpServletRequest request, HttpServletResponse response) {
    String name = request.getParameter("name");
    response.getWriter().println(name);
    response.getWriter().println("fixed");
  }
}
""",
    "web/app.py": """from db import run
@app.route('/find')
def find():
    return lookup(request.args['q'])

def lookup(q):
    cursor.execute("SELECT * FROM t WHERE n = '" + q + "'")
    cursor.execute("SELECT 1")
""",
    "web/server.js": """const show = (req, res) => {
  render(req.query.id);
};
function render(id) {
  return db.get(id);
}
app.get('/show', show);
""",
    "svc/main.go": """package main
func Handle(w http.ResponseWriter, r *http.Request) {
  work(r)
}
func work(r *http.Request) {
  exec(r)
}
func setup() {
  mux.HandleFunc("/h", Handle)
}
""",
    "native/io.cpp": """#include <cstring>
void copy(const char* in) {
  char small[8];
  memcpy(small, in, 16);
  memcpy(small, in, 4);
  strcpy(small, "a long literal");
  gets(small);
  system(in);
}
void drop() {
  int* a = new int[4];
  delete a;
  Node* n = nullptr;
  n->next();
}
""",
    "map/UserMapper.xml": """<?xml version="1.0"?>
<mapper namespace="shop.UserMapper">
  <select id="find">SELECT * FROM u ORDER BY ${column}</select>
  <select id="safe">SELECT * FROM u WHERE id = #{id}</select>
</mapper>
""",
    "conf/routes": "GET /play controllers.Home.index(id: Int)\n",
    "play/Home.scala": """class Home extends Controller {
  def index(id: Int) = {
    helper(id)
  }
  def helper(id: Int) = {
    1
  }
}
""",
}


def files(spark):
    return spark.createDataFrame(sorted(FILES.items()), "path string, text string")
